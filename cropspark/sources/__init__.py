"""Scans, sinks and the append-only store."""
