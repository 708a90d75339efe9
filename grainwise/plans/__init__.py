"""Registered queries, grouped by theme; importing this package fills the registry."""
