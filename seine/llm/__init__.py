"""Operators for building language-model training data. Nothing else in seine imports this subpackage."""
