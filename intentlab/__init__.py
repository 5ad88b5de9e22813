"""intentlab: session purchase-intent analytics on Spark (DataFrame, Spark ML, Structured Streaming)."""

__version__ = "0.1.0"
