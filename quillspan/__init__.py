"""Quillspan: a Spark-native engine for grounded question answering over document collections."""
