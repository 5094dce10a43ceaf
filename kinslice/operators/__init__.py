"""Relational operators of a subset run, as DataFrame to DataFrame functions."""
