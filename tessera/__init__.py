"""tessera: a Spark-native engine for catalog, retrieval, series and corpus data."""
