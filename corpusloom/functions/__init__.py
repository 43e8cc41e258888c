"""Corpusloom functions."""
