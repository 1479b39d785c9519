"""Spark-native analytics for alternative-splicing tables, junctions, alignments and reads."""

__version__ = "0.1.0"
