"""Patterns and the planners that order and share the work of matching them."""
