"""Scans, file catalogues and sinks."""
