"""operators of the knowledge engine."""
