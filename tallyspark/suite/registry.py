"""All check queries."""

from tallyspark.suite import cleaning, forecasting, mart, refunding, resolving, scoping, storing
from tallyspark.suite.base import ORACLES, QUERIES

MODULES = (scoping, cleaning, mart, resolving, storing, refunding, forecasting)

__all__ = ["MODULES", "ORACLES", "QUERIES"]
