"""Projections over event logs, in batch and with Structured Streaming."""
