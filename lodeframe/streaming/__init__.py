"""streaming of the knowledge engine."""
