"""Structured Streaming entry points over uploaded customer files."""
