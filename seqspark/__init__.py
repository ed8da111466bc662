"""A PySpark-native engine for guided search over sequences, and for preparing training data."""
