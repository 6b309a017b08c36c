"""Functions of the event-pipeline engine."""
