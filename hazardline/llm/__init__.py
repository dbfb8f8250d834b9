"""Operators for cleaning and mixing training text; nothing else in the library imports this subpackage."""
