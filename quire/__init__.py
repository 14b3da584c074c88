"""A Spark-native library for document structuring, quality analytics and training-data pipelines."""
