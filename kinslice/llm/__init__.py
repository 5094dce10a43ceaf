"""Operators of a training-data pipeline over tables of documents, web pages and benchmarks.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries when it is
present.
"""
