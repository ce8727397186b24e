"""lectern: a Spark-native engine for retrieving, ranking and evaluating evidence in document collections."""
