"""Named queries over the driver's tables, each with SQL that another engine can run."""

from . import process, similarity  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
