"""The query catalogue: each query with the SQL that says the same."""

from . import bursts, events, learning
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "bursts", "events", "learning"]
