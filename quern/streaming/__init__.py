"""Structured Streaming forms of the event and message views."""
