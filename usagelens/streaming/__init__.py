"""Structured Streaming ingestion and running aggregates."""
