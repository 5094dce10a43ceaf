"""Where catalogs come from."""

from . import jdbc, parquet, testdata

__all__ = ["jdbc", "parquet", "testdata"]
