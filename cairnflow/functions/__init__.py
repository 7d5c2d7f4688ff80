"""Scalar functions and the formula language, as column expressions."""
