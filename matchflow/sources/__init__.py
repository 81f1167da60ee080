"""Readers of landed payloads, feeds, logs and pages."""
