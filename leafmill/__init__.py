"""leafmill: document analytics and retrieval operators for PySpark."""

__version__ = "0.1.0"
