"""Queries over several operators: caches, relations, layers, the closed loop, files."""
