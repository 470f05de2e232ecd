"""Report queries and the history sync."""
