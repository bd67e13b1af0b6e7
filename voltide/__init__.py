"""voltide: realised-volatility analytics on per-second order books, written as Spark jobs."""

__version__ = "0.1.0"
