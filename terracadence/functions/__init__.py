"""Column functions. All take and return Columns; missing or non-finite inputs give NULL unless said otherwise."""
