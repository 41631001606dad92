"""Every operator as a query on the driver's tables, with the SQL that must agree."""

from lakepulse.checks import analyses, features, lake, monitoring, streams  # noqa: F401
from lakepulse.checks.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
