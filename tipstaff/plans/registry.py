"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from . import reference, training

QUERIES = {**reference.QUERIES, **training.QUERIES}
SQL = {**reference.SQL, **training.SQL}
