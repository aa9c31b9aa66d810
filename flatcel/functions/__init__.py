"""Column -> Column building blocks (no shuffles, no Python in the data path)."""
