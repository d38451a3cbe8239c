"""A PySpark-native analytics engine for sparse matrices, graphs and statistics."""
