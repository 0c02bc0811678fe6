"""gridline: semi-structured documents to clean records, as Spark plans."""

__version__ = "0.1.0"
