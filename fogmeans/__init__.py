"""Fuzzy clustering over federated partitions, expressed in Spark."""
