"""Workbooks and delimited sheets as Spark tables."""
