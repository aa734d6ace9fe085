"""Livestock operation and commodity market analytics on PySpark DataFrames."""
