"""tarnweave: a web-search corpus engine declared on Spark DataFrames."""

__version__ = "0.1.0"
