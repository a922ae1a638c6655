"""Scans and sinks (family S)."""
