"""All registered queries."""

from ledgerlens.plans.catalog import (  # noqa: F401
    finance,
    ingest,
    modelling,
    scoring,
    state,
    streams,
    training_table,
)
from ledgerlens.plans.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
