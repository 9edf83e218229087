"""oddrank: rank the rows of an unknown table by statistical oddity, on Spark."""

__version__ = "0.1.0"
