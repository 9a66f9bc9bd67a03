"""A Spark-native retrieval and analytics engine: every operator takes and returns DataFrames."""
