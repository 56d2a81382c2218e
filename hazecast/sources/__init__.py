"""Scans, payload handling, sinks and the model registry."""
