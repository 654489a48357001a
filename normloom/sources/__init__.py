"""Readers and writers, and the pure row transforms of the record sources."""
