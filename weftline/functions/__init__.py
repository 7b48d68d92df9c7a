"""Column functions: (Column, ...) -> Column."""
