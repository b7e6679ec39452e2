"""Matching, sampling, positional and event operators."""
