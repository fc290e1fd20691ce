"""Structured Streaming: views without near repeats, outboxes, presence."""
