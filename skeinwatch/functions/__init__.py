"""Column functions: metrics, rounding, addresses, display text."""
