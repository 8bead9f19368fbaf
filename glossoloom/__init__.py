"""glossoloom: a PySpark-native engine for building and querying sentence-aligned corpora."""

__version__ = "0.1.0"
