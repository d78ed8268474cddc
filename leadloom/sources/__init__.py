"""Readers of captured tables, files and vendor payloads."""
