"""Scans, sinks and table layouts."""
