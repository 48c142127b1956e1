"""Every registered query with the SQL that checks it."""

from daytrail.catalog import (  # noqa: F401
    explorer,
    geography,
    ingest,
    listening,
    messaging,
    movement,
    selection,
    streams,
)
from daytrail.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
