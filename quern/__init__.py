"""Approximate analytics and corpus operators for PySpark."""
