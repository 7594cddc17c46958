"""factgraph: source-code evidence and training-data analytics on Spark."""

__version__ = "0.1.0"
