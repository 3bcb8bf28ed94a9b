"""PySpark-native code-knowledge-graph analytics."""
