"""Queries over the data set's tables, each beside the SQL it is checked with."""
