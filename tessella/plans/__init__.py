"""Whole flows: index, search, research, health."""
