"""A PySpark-native analytics engine for hospital-pharmacy drug data."""
