"""Queries composed of the operators, and their SQL."""
