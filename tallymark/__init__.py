"""A PySpark-native analytics engine for file catalogs."""
