"""The order in which versions of a paper are tried."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_order(version: Column) -> Column:
    """Published before accepted before submitted before all others."""
    return F.when(version == "published", 0).when(version == "accepted", 1).when(version == "submitted", 2).otherwise(3)
