"""termweave: text retrieval and term statistics on Spark DataFrames."""

__version__ = "0.1.0"
