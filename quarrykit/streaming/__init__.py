"""Structured Streaming: staged log ingest, outbox, windows over events."""
