"""A PySpark-native event-pipeline and corpus-processing engine."""
