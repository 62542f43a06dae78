"""All queries of the core and their SQL."""

from __future__ import annotations

from weftline.plans import answers, intervals, library

_PARTS = [intervals, library, answers]
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
ORACLE = {k: s for p in _PARTS for k, s in p.ORACLE.items()}
FLAGSHIP = library.briefs
