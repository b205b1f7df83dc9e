"""textloom: document analytics and retrieval as Spark DataFrame plans."""

__version__ = "0.1.0"
