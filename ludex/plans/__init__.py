"""Derived-table jobs and the six questions."""
