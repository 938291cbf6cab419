"""Importing this module fills the registry."""

from tabwright.plans import (  # noqa: F401
    cdc_queries,
    compare_queries,
    drift_queries,
    document_queries,
    graph_queries,
    log_queries,
    modelled_queries,
    pii_queries,
    prep_queries,
    privacy_queries,
    profile_queries,
    relational_queries,
    series_queries,
    source_queries,
    streaming_queries,
    synthesis_queries,
)
from tabwright.plans.registry import ORACLES, QUERIES  # noqa: F401
