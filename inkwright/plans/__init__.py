"""Queries over the driver's tables, one or more for each operator, and their SQL."""
