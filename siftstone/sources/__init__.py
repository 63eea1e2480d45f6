"""Readers of the file formats the engine ingests, and its sinks."""
