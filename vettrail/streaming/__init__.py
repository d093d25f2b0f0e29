"""Structured Streaming forms of the limiter and of verification."""
