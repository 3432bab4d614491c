"""The event-time operators on Structured Streaming."""
