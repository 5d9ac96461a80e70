"""Structured Streaming over arriving acquisitions: an extension, since monitoring is otherwise a batch re-run."""
