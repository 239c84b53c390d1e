"""Streams of graph writes, merged batch by batch."""
