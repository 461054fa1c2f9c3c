"""A PySpark-native analytics engine for event-driven network models."""
