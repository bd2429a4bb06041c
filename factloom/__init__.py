"""Spark-native engine that turns report documents into audited numeric facts."""
