"""labelpool — pool-based active learning as Spark DataFrame plans."""

__version__ = "0.1.0"
