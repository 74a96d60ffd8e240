"""All registered queries of the library, and SQL for those that SQL can express."""

from . import chains, cycles, flows, further, marks, nulls, relations, scanned, sessions, steps, structures, studies  # noqa: F401
from .series import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
