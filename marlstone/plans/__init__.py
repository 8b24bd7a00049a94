"""Queries as trees of operators, with costs, and the planners that build them."""
