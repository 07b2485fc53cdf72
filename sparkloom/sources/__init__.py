"""Scans and parsers that fill the tables."""
