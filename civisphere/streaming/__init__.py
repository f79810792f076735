"""Editions as streams."""
