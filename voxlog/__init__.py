"""A Spark-native engine for versioned, spatially keyed record logs."""
