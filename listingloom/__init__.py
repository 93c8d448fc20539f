"""Spark-first product matching: text rules, pair building, labelling, ranking."""
