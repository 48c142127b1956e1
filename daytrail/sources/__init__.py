"""Readers for raw exports and writers for the typed tables."""
