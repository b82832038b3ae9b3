"""Hybrid retrieval and corpus analytics as DataFrame operations."""
