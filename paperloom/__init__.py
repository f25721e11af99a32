"""Spark-first analytics over large document libraries."""
