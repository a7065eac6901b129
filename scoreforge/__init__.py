"""A PySpark-native engine for sung-score transcriptions: encoding, parsing, alignment, metrics, batching."""
