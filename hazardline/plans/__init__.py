"""Composed pipelines: feature presets and whole experiments."""
