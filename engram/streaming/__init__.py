"""Structured Streaming: ingest, push de-duplication, usage."""
