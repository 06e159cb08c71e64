"""Structured Streaming views of a run."""
