"""Time-aware analytics on scheduled trips and observations, as Spark DataFrame jobs."""

__version__ = "0.1.0"
