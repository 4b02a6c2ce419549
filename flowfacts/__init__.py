"""A PySpark-native engine that analyses source code as data."""
