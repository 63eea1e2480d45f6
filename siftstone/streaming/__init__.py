"""Structured Streaming jobs over event logs; each gives what the batch query gives on the same rows."""
