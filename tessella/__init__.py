"""tessella: a Spark-native engine for curating and evaluating text datasets."""
