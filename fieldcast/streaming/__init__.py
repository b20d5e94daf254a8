"""Keyed updates of streams."""
