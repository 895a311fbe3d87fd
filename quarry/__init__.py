"""Quarry: a PySpark-native analytics engine for evidence tables and training corpora."""
