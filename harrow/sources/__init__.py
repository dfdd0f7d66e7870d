"""Readers of state files and of landed payloads; writers."""
