"""Readers and writers: price bars, instrument lists, strategy files, rankings and logs."""
