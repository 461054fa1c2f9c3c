"""Scalar functions: units, ticks and the expression language."""
