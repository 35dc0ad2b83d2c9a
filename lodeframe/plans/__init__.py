"""plans of the knowledge engine."""
