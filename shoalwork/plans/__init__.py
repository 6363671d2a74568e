"""Queries over the operators, with their SQL."""
