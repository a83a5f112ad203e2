"""Spark-native analytics for position-ordered count data (methylation and alike)."""
