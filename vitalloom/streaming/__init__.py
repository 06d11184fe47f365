"""Structured Streaming forms of the event-driven operators, each with a batch twin."""
