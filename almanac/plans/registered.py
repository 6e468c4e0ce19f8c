"""Importing this module imports every module that registers queries."""

from ..operators import annotations, calendar_tables, catalogues, claims, dating, event_table, joins, large_lexicon, lunations, pages, readers, reports, retrieval, sky_tables, statements, summaries  # noqa: F401
from ..sources import bundles, intake  # noqa: F401
from ..streaming import logs, stateful  # noqa: F401
