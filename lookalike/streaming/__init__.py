"""Incremental ingestion with the cache, and event-time windows."""
