"""Sources of price bars and auxiliary series."""
