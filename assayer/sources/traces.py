"""Traces of model calls in an SQLite file, for a service on one machine."""

from __future__ import annotations

import datetime as dt
import logging
import os
import sqlite3
from contextlib import closing
from pathlib import Path

from assayer.types import TRACE

#: Where traces go if neither the caller nor this variable names a file.
DEFAULT, VARIABLE = "eval/traces.sqlite", "ASSAYER_TRACES"
_KIND = {"long": "INTEGER", "bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "string": "TEXT"}


class SqliteTraces:
    """Each operation opens a connection of its own, so request threads do not meet."""

    def __init__(self, path: str | None = None):
        self.path = Path(path or os.environ.get(VARIABLE) or DEFAULT)
        self.columns = [f.name for f in TRACE if f.name != "id"]

    def _connect(self) -> sqlite3.Connection:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        db = sqlite3.connect(self.path)
        kinds = ", ".join(f"{f.name} {_KIND[f.dataType.simpleString()]}" for f in TRACE if f.name != "id")
        db.execute(f"CREATE TABLE IF NOT EXISTS traces (id INTEGER PRIMARY KEY AUTOINCREMENT, {kinds})")
        return db

    def record(self, call: dict) -> int:
        """Keep a call's numbers; returns the trace's id."""
        row = {"timestamp_utc": dt.datetime.now(dt.UTC).isoformat(timespec="seconds"), **call}
        row |= {"cost_usd": round(row["cost_usd"], 6), "ok": int(row["ok"])}
        with closing(self._connect()) as db, db:
            marks = ", ".join("?" for _ in self.columns)
            return int(db.execute(f"INSERT INTO traces ({', '.join(self.columns)}) VALUES ({marks})", [row.get(c) for c in self.columns]).lastrowid)

    def record_safely(self, call: dict) -> int | None:
        """The same, but a failure to trace never costs the caller its result."""
        try:
            return self.record(call)
        except Exception:
            logging.getLogger(__name__).exception("a call was not traced in %s", self.path)
            return None

    def recent(self, limit: int = 50) -> list[dict]:
        """The newest traces; none if nothing was ever traced."""
        if not self.path.exists():
            return []
        with closing(self._connect()) as db:
            db.row_factory = sqlite3.Row
            return [dict(r) for r in db.execute("SELECT * FROM traces ORDER BY id DESC LIMIT ?", (limit,))]
