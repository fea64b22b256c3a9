"""passagery: a PySpark-native passage-retrieval and relevance-analytics engine."""

__version__ = "0.1.0"
