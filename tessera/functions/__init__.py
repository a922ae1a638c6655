"""Shared column-level helpers."""
