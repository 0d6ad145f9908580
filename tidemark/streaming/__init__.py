"""Structured Streaming jobs for raw pulls that keep arriving."""
