"""Inputs: catalog/Parquet readers and the fixture inventories derived from the test tables."""

from spendguard.sources import fixtures
from spendguard.sources.tables import read_listing, read_table

__all__ = ["fixtures", "read_listing", "read_table"]
