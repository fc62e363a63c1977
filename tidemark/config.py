"""Configuration: a YAML file with source, target and sync."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

import yaml


class ConfigError(ValueError):
    """The configuration can't be used as it is."""


@dataclass(frozen=True)
class Endpoint:
    """One database: its kind and that kind's settings."""

    kind: str
    settings: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, name: str, raw: Any) -> Endpoint:
        if not isinstance(raw, dict):
            raise ConfigError(f"{name}: a mapping is needed")
        kind = raw.get("kind") or ("parquet" if "path" in raw else "jdbc")
        needed = {"parquet": ["path"], "warehouse": ["database"], "jdbc": [] if "url" in raw else ["host", "port", "user", "password", "database"]}
        if kind not in needed:
            raise ConfigError(f"{name}: unknown kind {kind!r}")
        if missing := [k for k in needed[kind] if raw.get(k) in (None, "")]:
            raise ConfigError(f"{name}: {', '.join(missing)} missing")
        return cls(kind, {k: v for k, v in raw.items() if k != "kind"})


@dataclass(frozen=True)
class SyncOptions:
    """How to copy.

    parallel_tables: tables at a time. chunk_size: key values in a chunk. batch_insert_size:
    rows in a JDBC batch. waves: commits to the ledger a table is split into, each of whole
    chunks or whole files and one Spark job; more waves lose less work to an interruption. Between stores of
    files each file is read once, however many there are. Unset: 16 at most for tables in files; for databases 4, or one for
    256 ranges of the key; 1 for files that go to a database, as each wave would scan them. sort_rows: order each written
    file by the key, so that later range scans can skip parts of it; a sort within tasks, no
    shuffle, and none for a database, which gives its rows in that order. tables: which, none for all.
    keys: primary keys by table, for sources that don't know them. unique: tables whose key must not repeat,
    which a target of files can't see to; a table where it does fails. retries: further attempts at a
    step that failed by an error that may pass; retry_seconds: the wait before the first, doubled for each
    further one up to a minute. verify: compare each table that was copied with its source before it is done; a table that
    differs fails, also if the source was written to meanwhile.
    """

    parallel_tables: int = 4
    chunk_size: int = 50_000
    batch_insert_size: int = 5_000
    waves: int | None = None
    sort_rows: bool = False
    tables: tuple[str, ...] = ()
    keys: dict[str, str | None] = field(default_factory=dict)
    unique: tuple[str, ...] = ()
    retries: int = 3
    retry_seconds: float = 1.0
    verify: bool = False

    def __post_init__(self) -> None:
        for name in ("parallel_tables", "chunk_size", "batch_insert_size", "waves"):
            value = getattr(self, name)
            if name == "waves" and value is None:
                continue
            if isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ConfigError(f"sync.{name} must be a whole number of at least 1, not {value!r}")
        if isinstance(self.retries, bool) or not isinstance(self.retries, int) or self.retries < 0:
            raise ConfigError(f"sync.retries must be a whole number of at least 0, not {self.retries!r}")
        if isinstance(self.retry_seconds, bool) or not isinstance(self.retry_seconds, int | float) or not 0 <= self.retry_seconds < float("inf"):
            raise ConfigError(f"sync.retry_seconds must be a number of at least 0, not {self.retry_seconds!r}")
        if not isinstance(self.verify, bool):
            raise ConfigError(f"sync.verify must be true or false, not {self.verify!r}")


@dataclass(frozen=True)
class Config:
    source: Endpoint
    target: Endpoint
    sync: SyncOptions

    @classmethod
    def of(cls, raw: Any) -> Config:
        if not isinstance(raw, dict):
            raise ConfigError("the configuration must be a mapping")
        if missing := [k for k in ("source", "target", "sync") if k not in raw]:
            raise ConfigError(f"{', '.join(missing)} missing")
        sync = dict(raw["sync"] or {})
        known = set(SyncOptions.__dataclass_fields__)
        if unknown := sorted(set(sync) - known):
            raise ConfigError(f"sync: unknown {', '.join(unknown)}")
        sync["tables"], sync["unique"] = tuple(sync.get("tables") or ()), tuple(sync.get("unique") or ())
        sync["keys"] = dict(sync.get("keys") or {})
        return cls(Endpoint.of("source", raw["source"]), Endpoint.of("target", raw["target"]), SyncOptions(**sync))


def load_config(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return Config.of(yaml.safe_load(f))
