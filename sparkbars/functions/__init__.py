"""Column helpers: frames, scalars, profit factors."""
