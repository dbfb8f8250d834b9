"""Scoring on unbounded input."""
