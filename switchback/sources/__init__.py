"""Readers and writers of map elements, tracks and terrain."""
