"""Readers and writers of the engine's file formats, all through Spark's own sources."""
