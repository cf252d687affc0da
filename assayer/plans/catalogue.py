"""Every registered query of the engine's own operators and its SQL oracle."""

from __future__ import annotations

from assayer.plans import audit, corpus, jobs, stored

QUERIES: dict = {**audit.QUERIES, **corpus.QUERIES, **stored.QUERIES, **jobs.QUERIES}
ORACLES: dict = {**audit.ORACLES, **corpus.ORACLES, **stored.ORACLES, **jobs.ORACLES}
