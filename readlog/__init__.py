"""A PySpark-native engine for reading histories of serialised works."""
