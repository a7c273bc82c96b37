"""Streams: files as they arrive, and request counts by time."""
