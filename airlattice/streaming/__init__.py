"""Structured Streaming re-aims of the reference's cron batches."""
