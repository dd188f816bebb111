"""Brindle: a Spark-native search and analytics engine for semi-structured documents."""

__version__ = "0.1.0"
