"""Structured Streaming jobs that keep messages, sessions and volumes current."""
