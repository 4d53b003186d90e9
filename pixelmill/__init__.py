"""PySpark-native analytics over tables of per-image features."""
