"""Regression models on the wide panel, built on pyspark.ml."""
