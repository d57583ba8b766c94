"""Structured Streaming: intake of reports and keyed state."""
