"""The queries of the repository, each with the SQL that states its expected result."""

from catalog import detection, evaluation, forecasting, preparation, profiling, reading  # noqa: F401
from catalog.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
