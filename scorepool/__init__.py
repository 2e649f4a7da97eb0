"""A Spark-native engine that scores, selects and audits pools of generated candidates."""
