"""tipstaff: provision search, cross-reference analytics and text pipelines on Spark."""

__version__ = "0.1.0"
