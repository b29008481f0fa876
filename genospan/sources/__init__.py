"""Readers of variant tables, sample tables and genotype matrices."""
