"""Plotfile series as a stream (an extension)."""
