"""Equality of typed values, and aggregate functions."""
