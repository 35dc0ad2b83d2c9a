"""sources of the knowledge engine."""
