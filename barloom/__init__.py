"""Spark jobs for price bars: indicators, entry rules, trades, metrics, scanners, streams."""
