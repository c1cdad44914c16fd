"""Scalar functions: all are expressions of built-in functions."""
