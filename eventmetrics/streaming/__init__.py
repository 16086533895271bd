"""Continuous versions of the operators as Structured Streaming queries."""
