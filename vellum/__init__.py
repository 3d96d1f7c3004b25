"""Vellum: document retrieval and text-data processing as PySpark DataFrame operators."""

__version__ = "0.1.0"
