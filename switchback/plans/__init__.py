"""Queries over the test tables, each calling an operator of this library, with SQL to check them."""
