"""Catalogue of ready queries over the given tables."""
