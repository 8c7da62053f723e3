"""Analytics and transformation of packaged office documents on Spark DataFrames."""

__version__ = "0.1.0"
