"""Structured Streaming over ordered logs."""
