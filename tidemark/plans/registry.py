"""All registered queries of the reference operators; importing the modules fills the dictionaries."""

from __future__ import annotations

from tidemark.plans import documents, files, pages, scalars, storage, tables  # noqa: F401
from tidemark.plans.base import ORACLES, QUERIES, query  # noqa: F401
