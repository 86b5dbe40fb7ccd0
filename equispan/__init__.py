"""Equity valuation analytics as Spark DataFrame transforms."""
