"""Spark-first analytics over large collections of product reviews."""
