"""Geodetic analytics on Spark: pipelines of coordinate operations compiled to DataFrame expressions."""
