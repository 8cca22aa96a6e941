"""Spark-native building blocks; see the package README."""
