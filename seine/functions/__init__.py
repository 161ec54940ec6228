"""Scalar functions and the pattern library as Column expressions."""
