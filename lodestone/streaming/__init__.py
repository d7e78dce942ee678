"""Structured Streaming: class events, windows, timers, state machines."""
