"""Structured Streaming twins of the frame operators."""
