"""Spark-native analytics for keypoint time series and training-data preparation."""
