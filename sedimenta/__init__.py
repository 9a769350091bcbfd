"""Spark jobs for embedding search and model data."""
