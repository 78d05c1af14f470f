"""Document retrieval, column profiling and assessment as Spark DataFrame jobs."""

__version__ = "0.1.0"
