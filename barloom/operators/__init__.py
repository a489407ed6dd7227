"""Operators on bars: indicators, signals, exits, metrics, labels, scanners."""
