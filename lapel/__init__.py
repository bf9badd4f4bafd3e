"""Retail sales analytics on PySpark: lazy DataFrame builders over a five-table star."""
