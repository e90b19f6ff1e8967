"""Streams of changes into tables."""
