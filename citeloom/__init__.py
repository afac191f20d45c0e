"""citeloom: Spark-native analytics for citation and co-occurrence data."""

__version__ = "0.1.0"
