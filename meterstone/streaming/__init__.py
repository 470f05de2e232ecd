"""Structured Streaming forms of the log operators and hourly usage."""
