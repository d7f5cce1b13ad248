"""veracell: a PySpark-native data-quality engine for large tables."""
