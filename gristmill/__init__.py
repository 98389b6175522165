"""A PySpark-native analytics library: sketches, indexes, digests, stateful decisions, as DataFrame operations."""
