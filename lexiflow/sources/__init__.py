"""Readers, literal tables and the catalogue store."""
