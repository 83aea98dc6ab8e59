"""Column helpers: Column in, Column out."""
