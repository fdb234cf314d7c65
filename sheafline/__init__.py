"""Spark-native document evidence analytics: sources, operators, plans and streaming jobs over DataFrames."""
