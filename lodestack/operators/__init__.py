"""Relational operators over the archive model."""
