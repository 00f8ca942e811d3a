"""Lodestack: a PySpark-native engine for content-addressed archive catalogues."""
