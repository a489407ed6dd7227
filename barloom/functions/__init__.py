"""Column builders: guarded rolling windows, smoothed means, entry rules."""
