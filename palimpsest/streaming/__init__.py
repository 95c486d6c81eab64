"""Streams of changes into repositories."""
