"""Structured Streaming: event time, expiry, routing, and ordered receivers with keyed state."""
