"""Technical-indicator analytics over OHLCV bars as PySpark DataFrame operators."""

__version__ = "0.1.0"
