"""Corpus-linguistics jobs on PySpark DataFrames."""
