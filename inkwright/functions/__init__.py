"""Column functions: each takes Columns and returns a Column, with no Python on the executors."""
