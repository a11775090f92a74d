"""Column functions and vectorized text functions."""
