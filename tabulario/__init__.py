"""Periodic business analytics on PySpark: sales, data quality and call logs."""
