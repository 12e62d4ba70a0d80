"""lithograph: Spark-native analytics over the history and structure of source repositories."""

__version__ = "0.1.0"
