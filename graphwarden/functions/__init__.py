"""Scalar helpers: datatypes, constants, regular expressions, value tests as columns."""
