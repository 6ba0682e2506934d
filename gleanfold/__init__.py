"""Gleanfold: federated listing search and large-corpus preparation as Spark jobs."""

__version__ = "0.1.0"
