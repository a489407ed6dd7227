"""Training-data operators: deduplication, joins, filters, mixing, packing and formats.

Nothing outside this subpackage imports it.
"""
