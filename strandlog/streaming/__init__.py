"""Logs that grow while they are read."""
