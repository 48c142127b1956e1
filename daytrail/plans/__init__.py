"""Reusable plan shapes: filters, top-k, skew-proof ordered passes, exact quantiles."""
