"""Registered queries with the SQL that checks them."""

from linkcast.catalog import (  # noqa: F401
    datasets, models, onetap, precompensation, reports, exports, signals, statistics, streaming, windows,
)
from linkcast.catalog.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
