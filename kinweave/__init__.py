"""kinweave: Spark-native entity resolution over contact records."""
