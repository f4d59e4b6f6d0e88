"""quern: a PySpark-native engine for building, questioning and diagnosing corpora of web pages."""
