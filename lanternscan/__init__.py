"""Secret and leak scanning, and corpus preparation, on PySpark."""

__version__ = "0.2.0"
