"""Durable intermediate tables, distributed ranks, and the registered queries."""
