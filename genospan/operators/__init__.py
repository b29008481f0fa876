"""Shapes, statistics and models over genotype datasets."""
