"""wayfold: Spark-native analytics for human-mobility data."""
