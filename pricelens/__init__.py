"""Catalog value analytics as DataFrame operators on Spark."""
