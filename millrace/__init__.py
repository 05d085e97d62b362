"""Millrace: table profiling, cleaning and feature building as Spark jobs."""

__version__ = "0.1.0"
