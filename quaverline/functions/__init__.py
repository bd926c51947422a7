"""Column functions and tables of fixed values."""
