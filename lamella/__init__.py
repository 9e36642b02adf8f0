"""Layered data pipelines on Apache Spark: bronze files, silver history, gold tables."""
