"""Readers and writers: source trees, reports."""
