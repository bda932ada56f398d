"""Extraction analytics on Spark: scoring, event-log questions, protection, quotas, streams."""
