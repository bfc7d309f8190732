"""Relational and graph operators over the code-graph tables."""
