"""Structured Streaming edges."""
