"""Corpusloom operators."""
