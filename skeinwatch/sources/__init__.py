"""Readers and writers: logs, topics, captures, archive, shared work tables."""
