"""Queries over the driver's tables, one for each operator, with SQL that gives the same rows."""
