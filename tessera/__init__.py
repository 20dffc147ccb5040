"""tessera: a batch analytics engine expressed in PySpark."""

__version__ = "0.1.0"
