"""All registered queries."""

from histloom.queries import (  # noqa: F401
    evaluation,
    groups,
    histories,
    interactions,
    records,
    signals,
    state,
    texts,
)
from histloom.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
