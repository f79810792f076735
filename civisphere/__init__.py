"""Civic news analytics on Spark."""
