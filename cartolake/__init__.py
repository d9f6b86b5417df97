"""cartolake: a PySpark-native engine for feature tables, bounding-box search and map-layer queries."""
