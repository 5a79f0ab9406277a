"""Readers of documents and tables, the chunk store, and interfaces to outside services."""
