"""Streaming jobs. Each has a batch twin with the same expressions."""
