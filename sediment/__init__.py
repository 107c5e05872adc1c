"""sediment: a Spark-native analytics engine for conversational memory and text corpora."""
