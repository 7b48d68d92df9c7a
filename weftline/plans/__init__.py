"""Configured pipelines."""
