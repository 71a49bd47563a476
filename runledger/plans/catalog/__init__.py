"""Every operator as a query over the test tables, with the SQL that must give the same rows."""

from __future__ import annotations

from .registry import ITEMS, QUERIES, sql_texts  # noqa: F401
from . import apps, events, files, flows, functions, jobs, logs, reads, storage, streams  # noqa: F401
