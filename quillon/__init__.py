"""Quillon: a Spark-native engine for structured documents, text and job event logs."""
