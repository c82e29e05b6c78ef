"""Structured Streaming over the log of agent runs."""
