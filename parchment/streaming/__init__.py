"""Resumable runs as streams."""
