"""Ingest of micro-batches into the store."""
