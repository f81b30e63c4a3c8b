"""Relational and time-series operators: DataFrame in, DataFrame out."""
