"""Streams over the same operators as batches, and what only streams have."""
