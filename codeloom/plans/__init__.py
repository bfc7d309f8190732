"""Query registry: every named query with its oracle SQL."""
