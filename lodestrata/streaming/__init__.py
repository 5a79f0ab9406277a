"""Structured Streaming: continuous ingestion into the chunk store."""
