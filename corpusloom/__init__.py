"""corpusloom: Spark-native building and judging of training data."""
