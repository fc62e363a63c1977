"""The progress ledger: an append-only log of events in the target, folded to the latest one for each table.

Spark tables have no UPDATE; appending needs none, and each event becomes visible in one step.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..model import Files, Progress
from ..sources.base import PROGRESS, RETRIES, SPLITS, Catalog

#: The names of the ledger's columns.
SCHEMA = (
    "seq long, table_name string, total_rows long, synced_rows long, primary_key string, last_pk_value decimal(38,0), "
    "status string, started_at timestamp, finished_at timestamp, updated_at timestamp, error string"
)
SPLITS_SCHEMA = "seq long, table_name string, files long, bytes long, rows long, last_file string, high decimal(38,0)"
RETRIES_SCHEMA = "seq long, table_name string, started_at timestamp, retries long, error string, updated_at timestamp"
RESET = "reset"
#: Events that are read before the log is cut down to the latest ones.
MOST_EVENTS = 1000


def _now() -> datetime:
    return datetime.now(UTC)


class EventLog:
    """One for a target and a name. Each table's events come from one thread; numbers rise over all of them and over runs."""

    name: str
    schema: str

    def __init__(self, target: Catalog):
        self.target = target
        self._lock = threading.Lock()
        self._seq: int | None = None
        self._latest: dict[str, dict] = {}

    def ensure(self) -> None:
        """Create the ledger if it is absent; read it once."""
        with self._lock:
            if self._seq is not None:
                return
            if not self.target.exists(self.name):
                self.target.create(self.name, self.kinds, None)
                self._seq = 0
                return
            found = self._folded().collect()  # a row for each table
            utc = lambda x: x.astimezone(UTC) if isinstance(x, datetime) else x  # noqa: E731  Spark hands out local times
            rows = [{k: utc(v) for k, v in r["e"].asDict().items()} for r in found]
            self._seq = max((r["seq"] for r in rows), default=0)
            self._latest = {r["table_name"]: r for r in rows}
            if sum(r["events"] for r in found) > max(MOST_EVENTS, 2 * len(found)):
                self.target.compact(self.name, self.kinds, rows)

    @property
    def kinds(self) -> StructType:
        return StructType.fromDDL(self.schema)

    def events(self) -> DataFrame:
        return self.target.load(self.name)

    def _folded(self) -> DataFrame:
        latest = F.max_by(F.struct(*[c for c in self.events().columns]), "seq")
        return self.events().groupBy("table_name").agg(latest.alias("e"), F.count(F.lit(1)).alias("events"))

    def fold(self) -> DataFrame:
        """The latest event of each table, forgotten ones included."""
        return self._folded().select("e.*")

    def _append(self, table: str, **values) -> None:
        self.ensure()
        with self._lock:
            self._seq += 1
            event = self._event(self._latest.get(table, {}), values) | {"seq": self._seq, "table_name": table}
            self.target.append_row(self.name, self.kinds, event)
            self._latest[table] = event

    def _event(self, latest: dict, values: dict) -> dict:
        """The new event's values, by its table's latest one."""
        return values


class Splits(EventLog):
    """How much of each table's files is in the target. An event is appended when a wave's rows are committed, before the ledger advances."""

    name, schema = SPLITS, SPLITS_SCHEMA

    def get(self, table: str) -> Files:
        self.ensure()
        e = self._latest.get(table)
        return Files(e["files"], e["bytes"], e["rows"], e["last_file"], None if e["high"] is None else int(e["high"])) if e else Files()

    def put(self, table: str, done: Files) -> None:
        self._append(table, files=done.files, bytes=done.bytes, rows=done.rows, last_file=done.last, high=None if done.high is None else Decimal(done.high))


class Retries(EventLog):
    """Attempts that failed and were made again: of each table the latest run that had any, known by its started_at in the ledger, how many, and the last one's error.

    The log is made with the first such event, so a target without it has had none.
    """

    name, schema = RETRIES, RETRIES_SCHEMA

    def put(self, table: str, started: datetime | None, retries: int, error: str) -> None:
        self._append(table, started_at=started, retries=retries, error=error, updated_at=_now())

    def get(self, table: str) -> int:
        """How often anything was tried again in the latest run that had to."""
        self.ensure()
        return self._latest.get(table, {}).get("retries", 0)


class Ledger(EventLog):
    """Each table's progress."""

    name, schema = PROGRESS, SCHEMA

    def __init__(self, target: Catalog, clock: Callable[[], datetime] = _now):
        super().__init__(target)
        self.clock = clock

    def progress(self) -> DataFrame:
        """A line for each table: the ledger as users see it."""
        return self.fold().where(F.col("status") != RESET).drop("seq")

    def get(self, table: str) -> Progress | None:
        self.ensure()
        e = self._latest.get(table)
        if e is None or e["status"] == RESET:
            return None
        values = {k: v for k, v in e.items() if k != "seq"}
        values["last_pk_value"] = None if e["last_pk_value"] is None else int(e["last_pk_value"])
        return Progress(**values)

    def _event(self, latest: dict, values: dict) -> dict:
        blank = dict.fromkeys(c.split(" ")[0] for c in SCHEMA.split(", ")) | {"total_rows": 0, "synced_rows": 0, "primary_key": ""}
        return {**blank, **latest, **values, "updated_at": self.clock()}

    def start(self, table: str, total: int, key: str, resumed: bool) -> None:
        """Running. Unless the table is resumed, what an earlier run has recorded is void."""
        fresh = {} if resumed else {"synced_rows": 0, "last_pk_value": None}
        self._append(table, total_rows=total, primary_key=key, status="running", started_at=self.clock(), finished_at=None, error=None, **fresh)

    def advance(self, table: str, synced: int, last: int | None) -> None:
        """All keys up to `last` are in the target (None: which ones isn't said, as with whole files). Only after the data are."""
        self._append(table, synced_rows=synced, last_pk_value=None if last is None else Decimal(last))

    def done(self, table: str, synced: int) -> None:
        self._append(table, synced_rows=synced, status="done", finished_at=self.clock(), error=None)

    def failed(self, table: str, error: str) -> None:
        self._append(table, status="failed", error=error)

    def reset(self, table: str | None = None) -> None:
        """Forget one table's progress, or all; the target's rows stay."""
        self.ensure()
        if table is not None and not table:
            raise ValueError("a table's name is needed")
        known = [t for t, e in self._latest.items() if e["status"] != RESET]
        for t in known if table is None else [t for t in known if t == table]:
            self._append(t, total_rows=0, synced_rows=0, primary_key="", last_pk_value=None, status=RESET, started_at=None, finished_at=None, error=None)
