"""All registered queries and their oracle SQL."""

from __future__ import annotations

from . import checks, corpus, events, files, grounding, outputs, pipelines, relational, scopes, signals, streams, texts, verification  # noqa: F401  (they register their queries)
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
