"""rillflow: a Spark-native engine for streams of transaction events."""
