"""Sentimill: market-sentiment analytics as Spark DataFrame transformations."""
