"""Copying tables: one wave of chunks after another, several tables at a time."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor, as_completed
from datetime import datetime

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Config, ConfigError, SyncOptions
from ..functions import quoted, whole
from ..model import Chunk, Comparison, Files, Mode, Progress, SourceFile, SyncResult, Wave
from ..plans import chunk_of, file_waves, first_key
from ..sources.base import PROGRESS, RETRIES, SPLITS, Catalog, open_catalog
from .ledger import Ledger, Retries, Splits
from .progress import INTERVAL, Watcher, group
from .reports import log_summary
from .retry import passes, pause
from .scan import range_of, usable_key
from .unique import repeated_keys
from .verify import verify

logger = logging.getLogger(__name__)
#: Waves of a table that lies in files.
FILE_WAVES = 16


class SchemaDrift(RuntimeError):
    """The target's columns aren't the source's."""


def _said(error: BaseException) -> str:
    return str(error).strip().split("\n")[0] or repr(error)


class RepeatedKeys(RuntimeError):
    """A key that was said not to repeat does."""


class Different(RuntimeError):
    """A table that was copied isn't what its source is."""


class SyncEngine:
    """Copies the tables of a source catalog into a target catalog.

    A keyed table goes in waves, and the ledger advances after a wave's rows are committed, so what it
    says is in the target is there. A wave that was written but not recorded is removed by the next
    run and copied again. Between stores of files a wave is a run of whole files, in the order of their paths, so
    all waves together read each file once; else it is a run of chunks, in ascending order of the key. A
    table without a usable key is replaced as a whole.

    `before_advance(table, wave)` is called between a wave's commit and its ledger event; a wave of
    files is the numbers of its first and last file. Running tables are reported every `interval` seconds.
    """

    def __init__(self, source: Catalog, target: Catalog, options: SyncOptions | None = None, clock: Callable[[], datetime] | None = None, before_advance: Callable[[str, Chunk], None] | None = None, interval: float = INTERVAL):
        self.source, self.target, self.options = source, target, options or SyncOptions()
        self.source.keys = {**self.source.keys, **self.options.keys}
        self.source.fetch_rows = self.options.batch_insert_size
        self.ledger, self.splits, self.retries = Ledger(target, clock) if clock else Ledger(target), Splits(target), Retries(target)
        self.watcher = Watcher(source.spark, interval)
        self.before_advance = before_advance or (lambda table, wave: None)
        if source.identity == target.identity:
            raise ConfigError("source and target are the same; copying would empty the source")

    @classmethod
    def of(cls, spark: SparkSession, config: Config) -> SyncEngine:
        return cls(open_catalog(spark, config.source, config.sync), open_catalog(spark, config.target, config.sync), config.sync)

    # Running.

    def run(self, mode: Mode = Mode.FULL) -> list[SyncResult]:
        """A result for each table, in the order in which they finish. One table's failure doesn't stop the others."""
        began = time.monotonic()
        self.ledger.ensure()
        if mode is Mode.RESTART:
            self.ledger.reset()
            logger.info("restart: all progress is forgotten")
        tables = self.tables()
        logger.info("tables: %s", ", ".join(tables))
        results = []
        self.watcher = Watcher(self.source.spark, self.watcher.interval)  # a thread starts once
        with self.watcher, ThreadPoolExecutor(self.options.parallel_tables) as pool:
            own = inheritable_thread_target(self.source.spark)(self._isolated)
            futures = [pool.submit(own, t, mode) for t in tables]
            for f in as_completed(futures):
                results.append(f.result())
        log_summary(results, time.monotonic() - began)
        return results

    def tables(self) -> list[str]:
        """Those that were asked for, or all of the source."""
        return [t for t in dict.fromkeys(self.options.tables) if t not in (PROGRESS, SPLITS, RETRIES)] or self.source.discover()

    def verify(self) -> dict[str, Comparison | Exception]:
        """Each table as it is in the target against the source, several at a time; nothing is written. An error stays with its table."""

        def one(table: str) -> Comparison | Exception:
            try:
                found = self._compare(table)
            except Exception as e:  # noqa: BLE001  whatever it is, it's this table's
                logger.error("table %s can't be compared: %s", table, _said(e))
                return e
            say = logger.info if found.same else logger.error
            say("table %s: %d of %d parts differ, %d rows missing, %d extra", table, found.differing, found.parts, found.missing_rows, found.extra_rows)
            return found

        tables = self.tables()
        with ThreadPoolExecutor(self.options.parallel_tables) as pool:
            own = inheritable_thread_target(self.source.spark)(one)
            return dict(zip(tables, pool.map(own, tables), strict=True))

    def _compare(self, table: str) -> Comparison:
        key, kinds = self.source.key(table), self.source.load(table).schema
        key = key if key in kinds.names and usable_key(kinds[key].dataType) else None
        return verify(*[c.all_rows(table, key, self.options.chunk_size) for c in (self.source, self.target)], key)

    def _verified(self, table: str) -> None:
        if not self.options.verify:
            return
        found = self._compare(table)
        if not found.same:
            raise Different(f"{found.missing_rows} rows are missing in the target and {found.extra_rows} are in it alone, in {found.differing} of {found.parts} parts")

    def _again[T](self, result: SyncResult, step: Callable[[], T]) -> T:
        """The step's result; it is tried again after errors that may pass. A step may be done twice without harm."""
        failed = 0
        while True:
            try:
                return step()
            except Exception as e:  # noqa: BLE001
                failed += 1
                if failed > self.options.retries or not passes(e):
                    raise
                wait = pause(failed, self.options.retry_seconds)
                result.retries += 1
                logger.warning("table %s: attempt %d failed (%s); again in %.1f s", result.table, failed, _said(e), wait)
                known = self.ledger.get(result.table)
                self.retries.put(result.table, known.started_at if known else None, result.retries, _said(e))
                time.sleep(wait)

    def _isolated(self, table: str, mode: Mode) -> SyncResult:
        began = time.monotonic()
        self.source.spark.sparkContext.setJobGroup(group(table), f"copying {table}")
        result = SyncResult(table)
        self.watcher.begin(result)
        try:
            self._copy(result, mode is Mode.RESUME)
        except Exception as e:  # noqa: BLE001  whatever it is, it's this table's
            result.error = _said(e)
            logger.error("table %s failed: %s", table, result.error)
            try:
                self.ledger.failed(table, result.error)
            except Exception as also:  # noqa: BLE001
                logger.error("table %s: its failure can't be recorded: %s", table, _said(also))
        finally:
            self.watcher.end(table)
        result.time = 0.0 if result.skipped else time.monotonic() - began
        return result

    def _copy(self, result: SyncResult, resume: bool) -> None:
        table = result.table
        rows = self.source.full_scan(table)
        if not rows.columns:
            raise ValueError("no columns")
        key = self.source.key(table)
        if key is not None and key not in rows.columns:
            raise ValueError(f"the key {key} is no column")
        if key is None or not usable_key(rows.schema[key].dataType):
            logger.warning("table %s has %s; it is copied as a whole", table, f"a key of type {rows.schema[key].dataType.simpleString()}" if key else "no primary key")
            self._copy_whole(result, rows)
        else:
            self._copy_keyed(result, rows, key, resume)

    def _ensure(self, table: str, rows: DataFrame, key: str, last: int | None, keep: bool) -> None:
        """The target table, holding nothing but what is committed up to `last`."""
        if not self.target.exists(table):
            self.target.create(table, rows.schema, key, self.source.key_columns(table), self.source.definition(table))
            return
        self._same_schema(table, rows)
        if keep:
            self.target.drop_after(table, key, last)
        else:
            self.target.truncate(table)

    def _same_schema(self, table: str, rows: DataFrame) -> None:
        kinds = lambda df: {f.name.lower(): f.dataType.simpleString() for f in df.schema}
        ours, theirs = kinds(rows), kinds(self.target.load(table))
        if ours != theirs and not (self.target.indexed and ours.keys() == theirs.keys()):  # a JDBC target has its own types
            changed = sorted(set(ours.items()) ^ set(theirs.items()))
            raise SchemaDrift(f"the target's columns differ: {', '.join(f'{n} {k}' for n, k in changed)}")

    def _copy_keyed(self, result: SyncResult, rows: DataFrame, key: str, resume: bool) -> None:
        table = result.table
        known = self.ledger.get(table) if resume else None
        if known and known.status == "done":
            self._complete(result, known)
            return
        by_range = known is not None and known.last_pk_value is not None  # begun so; goes on so
        files = None if by_range or self.source.indexed or self.target.indexed else self._again(result, lambda: self.source.files(table))
        if files is None:
            self._copy_ranges(result, rows, key, known)
        else:
            self._copy_files(result, rows, key, known, files)
        if not result.skipped:
            self._check_key(table, key)
            self.target.finish(table)
            self._verified(table)
            self.ledger.done(table, result.rows)

    def _complete(self, result: SyncResult, known: Progress) -> None:
        result.rows, result.skipped = known.synced_rows, True
        logger.info("table %s is complete already (%d rows)", result.table, known.synced_rows)

    def _check_key(self, table: str, key: str) -> None:
        if table in self.options.unique and (n := repeated_keys(self.target.load(table), key)):
            raise RepeatedKeys(f"the key {key} repeats: {n} rows have a key that another row has already")

    def _no_nulls(self, n: int, key: str) -> None:
        if n:
            raise ValueError(f"{n} rows have a null key {key}; configure the table's key as null to copy it as a whole")

    def _copy_files(self, result: SyncResult, rows: DataFrame, key: str, known: Progress | None, files: list[SourceFile]) -> None:
        """Waves of whole files. Their paths order them, and the last one copied is the mark that a later run goes on from."""
        table, o = result.table, self.options
        done = self.splits.get(table) if known else Files()
        before = files[: done.files]
        if done.files and (len(before) < done.files or before[-1].path != done.last or sum(f.bytes for f in before) != done.bytes):
            logger.warning("table %s: files that were copied have changed; it is copied from the start", table)
            known, done = None, Files()
        if known is None:  # old progress is void before the target is emptied
            self.splits.put(table, Files())
        total = sum(f.rows for f in files)
        self.ledger.start(table, total, key, resumed=known is not None)
        self.watcher.expect(table, total)
        self._ensure(table, rows, key, done.files - 1 if done.files else None, keep=known is not None)
        result.rows = done.rows
        for wave in file_waves(files[done.files :], o.waves or FILE_WAVES):
            span = Chunk(done.files, done.files + len(wave) - 1)
            found = self._again(result, lambda: self._write_files(table, wave, span, key))  # noqa: B023  called at once
            if found["rows"] != found["keyed"]:
                self.target.drop_after(table, key, span.start - 1 if span.start else None)
                self._no_nulls(found["rows"] - found["keyed"], key)
            self.before_advance(table, span)
            high = max((int(x) for x in (done.high, found["high"]) if x is not None), default=None)
            done = Files(span.end + 1, done.bytes + sum(f.bytes for f in wave), done.rows + found["rows"], wave[-1].path, high)
            self.splits.put(table, done)
            result.rows, result.copied = done.rows, result.copied + found["rows"]
            self.ledger.advance(table, done.rows, high if done.files == len(files) else None)

    def _write_files(self, table: str, wave: list[SourceFile], span: Chunk, key: str) -> dict:
        """rows, rows with a key (keyed) and the greatest key (high) of a wave of files, which is then in the target."""
        k, seen = F.col(quoted(key)), Observation(f"{table} {span.start}")
        part = self.source.file_scan(table, wave[0].path, wave[-1].path).observe(seen, F.count(F.lit(1)).alias("rows"), F.count(k).alias("keyed"), F.max(k).alias("high"))
        self.target.write_wave(table, part.sortWithinPartitions(k) if self.options.sort_rows else part, span, key, self.options.batch_insert_size)
        return seen.get

    def _copy_ranges(self, result: SyncResult, rows: DataFrame, key: str, known: Progress | None) -> None:
        """Waves of key ranges, in ascending order."""
        table, o = result.table, self.options
        keys = self._again(result, lambda: range_of(self.source.key_stats(table, key)))
        self._no_nulls(keys.nulls, key)
        last = known.last_pk_value if known else None
        if last is not None and last >= keys.high:
            self.ledger.done(table, known.synced_rows)
            self._complete(result, known)
            return
        result.rows = known.synced_rows if known else 0
        # The ledger first: if the target is emptied and this run dies, no old progress must speak for it.
        self.ledger.start(table, keys.rows, key, resumed=known is not None)
        self.watcher.expect(table, keys.rows)
        self._ensure(table, rows, key, last, keep=known is not None)
        if keys.rows:
            span = Chunk(first_key(keys, last), keys.high)
            self._copy_waves(result, rows, key, self._again(result, lambda: self.source.key_waves(table, key, span, o.chunk_size, o.waves)))

    def _copy_waves(self, result: SyncResult, rows: DataFrame, key: str, plan: list[Wave]) -> None:
        table = result.table
        filled = self._again(result, lambda: self._filled(rows, key, plan))
        for number, wave in enumerate(plan):
            if number in filled:
                copied = self._again(result, lambda: self._write_range(table, number, wave, key))  # noqa: B023  called at once
                result.rows, result.copied = result.rows + copied, result.copied + copied
            self.before_advance(table, wave)
            if number in filled or number == len(plan) - 1:  # an empty wave is covered by the next event
                self.ledger.advance(table, result.rows, wave.end)

    def _write_range(self, table: str, number: int, wave: Wave, key: str) -> int:
        """The number of rows of a wave of key ranges, which is then in the target."""
        o, seen = self.options, Observation(f"{table} {number}")
        part = self.source.range_scan(table, key, wave, o.chunk_size).observe(seen, F.count(F.lit(1)).alias("rows"))
        part = part.sortWithinPartitions(F.col(quoted(key))) if o.sort_rows and not self.source.ordered else part
        self.target.write_wave(table, part, wave, key, o.batch_insert_size)
        return seen.get["rows"]

    def _filled(self, rows: DataFrame, key: str, plan: list[Chunk]) -> set[int]:
        """Numbers of the waves that have rows: at most as many numbers as waves come to the driver. A source with an index isn't asked; it reads an empty wave fast."""
        if len(plan) == 1 or self.source.indexed:
            return set(range(len(plan)))
        k, width = F.col(quoted(key)), plan[0].end - plan[0].start + 1
        found = rows.where(k >= whole(plan[0].start)).select(chunk_of(k, plan[0].start, width).alias("wave")).distinct().collect()
        return {int(r["wave"]) for r in found}

    def _copy_whole(self, result: SyncResult, rows: DataFrame) -> None:
        table = result.table
        total = self._again(result, lambda: self.source.count(table))
        self.ledger.start(table, total, "", resumed=False)
        self.watcher.expect(table, total)
        self.target.recover(table)
        if self.target.exists(table):
            self._same_schema(table, rows)
        else:
            self.target.create(table, rows.schema, None, self.source.key_columns(table), self.source.definition(table))
        result.rows = result.copied = self._again(result, lambda: self._replace(table, total))
        self.target.finish(table)
        self._verified(table)
        self.ledger.done(table, result.rows)

    def _replace(self, table: str, total: int) -> int:
        """The number of rows, which are then the whole target table."""
        seen = Observation(table)
        self.target.recover(table)  # what an attempt before this one may have left
        part = self.source.bulk_scan(table, total, self.options.chunk_size)
        self.target.replace(table, part.observe(seen, F.count(F.lit(1)).alias("rows")), self.options.batch_insert_size)
        return seen.get["rows"]
