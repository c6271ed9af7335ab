"""capweave: a capture-index query and derive engine on PySpark DataFrames."""

__version__ = "0.1.0"
