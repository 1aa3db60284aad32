"""Alignment quality control and interval analytics as Spark DataFrame operators."""
