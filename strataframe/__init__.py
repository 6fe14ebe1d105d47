"""Spatial tables and text pipelines on PySpark DataFrames."""
