"""Scans, column layouts and sinks."""
