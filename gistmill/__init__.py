"""gistmill: a Spark-native engine that condenses mail and documents into size-bounded digests."""
