"""Queries and jobs."""
