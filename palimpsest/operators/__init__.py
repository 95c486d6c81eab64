"""Operators over commit graphs, each a composition of DataFrame operations."""
