"""Corpusloom streaming."""
