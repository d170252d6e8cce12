"""Divide-and-conquer analytics as declarative Spark plans."""
