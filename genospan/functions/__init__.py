"""Parameter parsing, count expressions and numerics."""
