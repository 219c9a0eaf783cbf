"""A Spark-native engine for preparing, sampling, packing and auditing language-model training data."""
