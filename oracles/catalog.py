"""All check SQL by query name."""
from . import backtest, entities, forward, fundamentals, metrics, valuation

SQL = {**fundamentals.SQL, **entities.SQL, **metrics.SQL, **valuation.SQL, **backtest.SQL, **forward.SQL}
