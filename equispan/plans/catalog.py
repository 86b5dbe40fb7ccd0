"""All registered queries."""
from . import (queries_backtest, queries_entities, queries_forward, queries_fundamentals,  # noqa: F401
               queries_metrics, queries_valuation)  # noqa: F401
from .registry import QUERIES  # noqa: F401
