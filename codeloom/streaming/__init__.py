"""Structured Streaming: the file-change feed and its debouncing."""
