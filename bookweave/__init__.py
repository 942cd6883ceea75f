"""Bookweave: investment-book analytics as Spark DataFrame operators."""
