"""Revisions as they arrive."""
