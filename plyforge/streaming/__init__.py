"""Incremental merging of generated answers."""
