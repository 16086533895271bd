"""Event sources, ingestion checks and the event store."""
