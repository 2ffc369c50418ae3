"""Spark-native analytics over tracking time series, with operators for tables around them."""
