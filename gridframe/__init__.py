"""gridframe: Spark-native planning, cropping and batching of chunked n-dimensional arrays."""

__version__ = "0.1.0"
