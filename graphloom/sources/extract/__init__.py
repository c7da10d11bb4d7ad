"""Extractors: one source text in, relations out. ``registry`` runs them over files."""
