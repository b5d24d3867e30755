"""Structured Streaming: event logs, windows, stalls."""
