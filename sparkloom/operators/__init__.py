"""Relational operators over the code and corpus tables."""
