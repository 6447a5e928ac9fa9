"""Operators for preparing training text, their queries and the SQL these are checked against."""
