"""A PySpark-native engine that curates listings of opportunities."""
