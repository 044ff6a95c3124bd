"""framequery: a PySpark-native analytics library for image-text pipelines."""

__version__ = "0.1.0"
