"""Leafweir: document-evidence analytics on PySpark DataFrames."""
