"""Spark-native data engine for presentation-attack evaluation, face galleries and training-data tables."""
