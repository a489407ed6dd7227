"""Bars over event streams."""
