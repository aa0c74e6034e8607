"""symgraph: a PySpark-native engine for code knowledge graphs."""
