"""Plan-level helpers shared by readers and operators."""
