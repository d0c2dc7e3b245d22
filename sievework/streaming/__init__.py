"""Telemetry as Structured Streaming."""
