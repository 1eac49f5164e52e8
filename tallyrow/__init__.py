"""A PySpark-native engine for line-oriented text and per-key event streams."""
