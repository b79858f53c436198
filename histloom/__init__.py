"""Shopper-history analytics as PySpark DataFrame jobs."""
