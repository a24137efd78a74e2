"""Imports every module that registers queries."""

from joinlift.plans import (  # noqa: F401
    assoc_queries, lake_queries, model_queries, pair_queries, repeated_queries, source_queries,
)
from joinlift.plans.registry import ORACLES, QUERIES  # noqa: F401
