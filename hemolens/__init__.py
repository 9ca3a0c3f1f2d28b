"""Spark-native analytics for screening peptides for hemolytic toxicity."""
