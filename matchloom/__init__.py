"""Spark-native matching of labelled hierarchies, with training-data operators in ``llm``."""
