"""gneiss: evidence retrieval, gating and text-table processing on PySpark."""

__version__ = "0.1.0"
