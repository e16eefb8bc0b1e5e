"""Spark-native analytics for geospatial site prospecting."""
