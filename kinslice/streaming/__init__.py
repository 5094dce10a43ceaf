"""Streams that keep a subset up to date."""

from .grow import grow_on

__all__ = ["grow_on"]
