"""All registered queries of the library's own operators and their SQL twins."""

from __future__ import annotations

from . import composed, evaluation, matching, relational, text, vocabularies
from .base import Query

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
for _module in (text, relational, matching, evaluation, composed, vocabularies):
    QUERIES |= _module.R.queries
    ORACLES |= _module.R.oracles
