"""Corpusloom sources."""
