"""A PySpark-native analytics engine for multilingual text corpora."""
