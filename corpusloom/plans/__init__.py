"""Corpusloom plans."""
