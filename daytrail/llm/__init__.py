"""Operators for preparing training text at scale, with their queries and SQL checks."""
