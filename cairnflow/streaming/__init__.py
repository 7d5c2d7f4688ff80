"""Structured Streaming: change events through the rules, with keyed record state."""
