"""Plans of the event-pipeline engine."""
