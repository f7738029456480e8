"""Spark-native analytics for exam papers: layout, rules, scoring, review."""
