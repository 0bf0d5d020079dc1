"""Scientometric analytics on Spark: corpora, indicators, reports, cubes and citation graphs."""
