"""functions of the knowledge engine."""
