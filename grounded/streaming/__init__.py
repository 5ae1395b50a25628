"""Structured Streaming jobs (continuous answering, ingest, request rates)."""
