"""Referential subsetting and data processing on Spark."""
