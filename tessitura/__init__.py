"""Acoustic fingerprint analytics on PySpark."""
