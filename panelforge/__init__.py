"""A Spark-native analytics engine for panels of price bars."""
