"""textloom: a PySpark-native engine for text quality and language-resource work."""

__version__ = "0.1.0"
