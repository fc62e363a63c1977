"""Operator 12: vector codes by part, with codebooks that are searched through vantage-point trees.

A vector's components become whole numbers and are cut into equal parts; each part position
has a codebook of a few entries, and a part's code is its nearest entry. Codebooks begin as
the parts of the smallest ids and are moved to their parts' means in a fixed number of rounds.

Each round is one scan: tasks assign their own vectors and add up the parts of each entry, so a
task hands on one row for each entry's component. All sums are of whole numbers, hence
the same in whatever order they are made, and by whichever executor.

An entry is found by branch and bound. A node of a tree has a vantage entry; those nearer
to it than the median are on one side, the others on the other side. The triangle inequality spares the
sides that can't hold a nearer entry. Distances there are rounded outwards and a side is visited if
its bound equals the best distance as well; what is visited is compared as squared whole
numbers, so neither rounding nor ties change the code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import column, settled

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components up to this size give whole numbers of 64 bits.
LARGEST = float(1 << 50)
#: The greatest error that a long holds; a sum beyond it is given as this.
MOST = (1 << 63) - 1
#: Rounds distances outwards, by more than all the steps that lead to them can be off.
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48
ROWS_AT_ONCE = 8192
#: A label of more than this share of the rows is met by broadcast; fewer than 1,000 labels can be.
COMMON = 1000


def usable(vectors: DataFrame, id: str, vector: str, *more: str) -> DataFrame:
    """(vec_id, v, more): rows whose vector isn't null and holds neither nulls nor values that aren't finite (or whose whole numbers 64 bits can't hold)."""
    v = column(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return vectors.select(column(id).cast("long").alias("vec_id"), v.alias("v"), *[column(c).alias(n) for n, c in zip(("label",), more, strict=False)]).where(F.coalesce(fine, F.lit(False)))


def cuts(d: int) -> list[int]:
    """Bounds of the parts of d components: equal ones where d is a multiple of PARTS, else the first ones have one more."""
    return [p * (d // PARTS) + min(p, d % PARTS) for p in range(PARTS + 1)]


def whole_numbers(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """(rows, d, whole numbers) of a batch's vectors, those of one dimension together."""
    v = batch.column(batch.schema.get_field_index("v"))
    sizes = np.diff(v.offsets.to_numpy())
    starts, flat = np.cumsum(sizes) - sizes, v.flatten().to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        for i in range(0, len(rows), ROWS_AT_ONCE):
            own = rows[i : i + ROWS_AT_ONCE]
            yield own, d, np.floor(flat[starts[own][:, None] + np.arange(d)] * SCALE).astype(np.int64)


def fitting(numbers: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in 64 bits if sums of squared differences fit, else as Python's whole numbers, which have no limit."""
    most = max((int(abs(x).max()) for x in (numbers, entries) if x.size), default=0)
    exact = object if (2 * most + 1) ** 2 * max(1, numbers.shape[1]) > MOST else np.int64
    return numbers.astype(exact), entries.astype(exact)


def squared(x: np.ndarray, entry: np.ndarray) -> np.ndarray:
    away = x - entry
    return (away * away).sum(1) if x.shape[1] else np.zeros(len(x), x.dtype)


def root(x) -> np.ndarray:
    return np.sqrt(np.asarray(x).astype(np.float64))


@dataclass
class Node:
    """A vantage entry, and the others as two sides; bounds of a side are its least and greatest squared distance from the vantage."""

    entry: int
    sides: list[tuple[Node, float, float]]
    middle: object = 0  # greatest squared distance on the near side

    @classmethod
    def of(cls, entries: np.ndarray, numbers: list[int]) -> Node:
        entry, rest = numbers[0], numbers[1:]
        if not rest:
            return cls(entry, [])
        away = squared(entries[rest], entries[entry]).tolist()
        order = sorted(range(len(rest)), key=lambda i: (away[i], rest[i]))
        half = (len(order) + 1) // 2
        sides = [x for x in (order[:half], order[half:]) if x]
        bound = lambda x: (float(root(away[x[0]]) * DOWN), float(root(away[x[-1]]) * UP))
        return cls(entry, [(cls.of(entries, sorted(rest[i] for i in x)), *bound(x)) for x in sides], away[sides[0][-1]])


class Tree:
    """The entries of one part position."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.top = Node.of(entries, list(range(len(entries))))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each row the nearest entry, the lowest of equally near ones, and the squared distance."""
        code = np.zeros(len(x), np.int64)
        best = squared(x, self.entries[0])
        self._visit(self.top, np.arange(len(x)), x, code, best)
        return code, best

    def _visit(self, node: Node, rows: np.ndarray, x: np.ndarray, code: np.ndarray, best: np.ndarray) -> None:
        if not len(rows):
            return
        away = squared(x[rows], self.entries[node.entry])
        better = (away < best[rows]) | ((away == best[rows]) & (node.entry < code[rows]))
        code[rows[better]], best[rows[better]] = node.entry, away[better]
        if not node.sides:
            return
        d, near = root(away), np.asarray(away <= node.middle, bool)
        for own_side in (True, False):  # each row first visits the side that it lies on
            for k, (side, least, most) in enumerate(node.sides):
                turn = np.flatnonzero((near == (k == 0)) == own_side)
                bound = np.maximum(d[turn] * DOWN - most, least - d[turn] * UP) * DOWN
                may = bound <= root(best[rows[turn]]) * UP
                self._visit(side, rows[turn[may]], x, code, best)


@dataclass
class Codebooks:
    """Of one dimension: by part position a matrix of entries."""

    parts: list[np.ndarray]

    def codes(self, numbers: np.ndarray) -> tuple[np.ndarray, list]:
        """Codes of each row by part, and by part the squared distances."""
        at, codes, errors = cuts(numbers.shape[1]), np.zeros((len(numbers), PARTS), np.int64), []
        for p, entries in enumerate(self.parts):
            x, entries = fitting(numbers[:, at[p] : at[p + 1]], entries)
            codes[:, p], error = Tree(entries).nearest(x)
            errors.append(error)
        return codes, errors

    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for entries in self.parts for x in entries.ravel()).encode()).hexdigest()


def _smallest(batches):
    """A task's rows with the smallest ids, by dimension; of an id that repeats, the least vector; rows without an id count as one, the last."""
    kept: dict[int, dict] = {}
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("vec_id")).to_numpy(zero_copy_only=False)
        v = batch.column(batch.schema.get_field_index("v"))
        order = np.lexsort((ids, np.isnan(ids.astype(np.float64)))) if ids.dtype.kind == "f" else np.argsort(ids, kind="stable")
        sizes = np.diff(v.offsets.to_numpy())
        for d in np.unique(sizes).tolist():
            own = kept.setdefault(d, {})
            for i in order[sizes[order] == d].tolist():
                one = batch.column(batch.schema.get_field_index("vec_id"))[i].as_py()
                key = (one is None, one or 0)
                if len(own) >= ENTRIES and key > max(own):
                    break
                values = v[i].as_py()
                if key not in own or values < own[key]:
                    own[key] = values
                if len(own) > ENTRIES:
                    del own[max(own)]
    rows = [(d, None if null else i, values) for d, own in kept.items() for (null, i), values in own.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["d", "vec_id", "v"])


def first_codebooks(rows: DataFrame) -> dict[int, Codebooks]:
    """By dimension: the parts of the smallest ids, ascending. A task hands on a few rows, so the rest is small."""
    few = rows.select("vec_id", "v").mapInArrow(_smallest, "d int, vec_id long, v array<double>").groupBy("d", "vec_id").agg(F.min("v").alias("v"))
    place = F.row_number().over(W.partitionBy("d").orderBy(F.asc_nulls_last("vec_id")))
    found: dict[int, list] = {}
    for r in few.withColumn("place", place).where(F.col("place") <= ENTRIES).orderBy("d", "place").collect():
        found.setdefault(r["d"], []).append(r["v"])
    out = {}
    for d, values in found.items():
        numbers, at = np.floor(np.array(values, np.float64).reshape(len(values), d) * SCALE).astype(np.int64), cuts(d)
        out[d] = Codebooks([numbers[:, at[p] : at[p + 1]] for p in range(PARTS)])
    return out


def _sums(shared):
    """A task's sums: of each entry of each part position the parts assigned to it, and for each of its components their sum."""

    def run(batches):
        total: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for _, d, numbers in whole_numbers(batch):
                codes, _ = shared.value[d].codes(numbers)
                at = cuts(d)
                for p in range(PARTS):
                    part = fitting(numbers[:, at[p] : at[p + 1]], np.zeros((0, 0), np.int64))[0]
                    for e in np.unique(codes[:, p]).tolist():
                        own = codes[:, p] == e
                        now = total.setdefault((d, p, e), [0, [0] * (at[p + 1] - at[p])])
                        now[0] += int(own.sum())
                        now[1] = [a + int(b) for a, b in zip(now[1], part[own].sum(0).tolist(), strict=True)]
        rows = [(*key, i, n, Decimal(x)) for key, (n, sums) in total.items() for i, x in enumerate(sums)]
        kinds = {"d": pa.int32(), "part": pa.int32(), "entry": pa.int32(), "at": pa.int32(), "n": pa.int64(), "s": pa.decimal128(38, 0)}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], list(kinds))

    return run


def moved(rows: DataFrame, books: dict[int, Codebooks]) -> dict[int, Codebooks]:
    """One round: every part is assigned, then each entry becomes the floor of its parts' mean; unused ones stay."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    summed = rows.select("v").mapInArrow(_sums(shared), "d int, part int, entry int, at int, n long, s decimal(38,0)")
    summed = summed.groupBy("d", "part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = {d: Codebooks([x.copy() for x in b.parts]) for d, b in books.items()}
    for r in summed.collect():  # one number for each component of the codebooks
        out[r["d"]].parts[r["part"]][r["entry"], r["at"]] = int(r["s"]) // r["n"]
    shared.unpersist()
    return out


def fit_codebooks(rows: DataFrame, rounds: int = ROUNDS) -> dict[int, Codebooks]:
    """Codebooks by dimension, of which there must be few: the driver holds ENTRIES vectors of each."""
    books = first_codebooks(rows)
    for _ in range(rounds):
        books = moved(rows, books)
    return books


def coded(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """vec_id, label, code, error, codebooks_sha256."""
    shared = rows.sparkSession.sparkContext.broadcast((books, {d: b.sha256() for d, b in books.items()}))

    def run(batches):
        books, marks = shared.value
        for batch in batches:
            code, error, mark = np.full(batch.num_rows, "", object), np.zeros(batch.num_rows, np.int64), np.full(batch.num_rows, "", object)
            for own, d, numbers in whole_numbers(batch):
                codes, errors = books[d].codes(numbers)
                hexed = codes.astype(np.uint8).tobytes().hex()
                code[own] = [hexed[i : i + 2 * PARTS] for i in range(0, len(hexed), 2 * PARTS)]
                error[own] = [min(sum(x), MOST) for x in zip(*[e.tolist() for e in errors], strict=True)]
                mark[own] = marks[d]
            keep = [batch.column(batch.schema.get_field_index(c)) for c in ("vec_id", "label")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(code, pa.string()), pa.array(error), pa.array(mark, pa.string())], ["vec_id", "label", "code", "error", "codebooks_sha256"])

    schema = StructType([rows.schema["vec_id"], StructField("label", rows.schema["label"].dataType), *StructType.fromDDL("code string, error long, codebooks_sha256 string")])
    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def with_label_errors(rows: DataFrame) -> DataFrame:
    """rows with label_error, the error summed over equal labels, nulls together.

    The sums of common labels are few by their share, so they are broadcast; what has another label
    is joined by it, and no such label is large.
    """
    total = rows.count()
    sums = settled(rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(Decimal(MOST))).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n")))
    is_common = F.col("n") * COMMON > total
    common, rare = (sums.where(x).select(F.col("label").alias("_label"), "label_error") for x in (is_common, ~is_common))
    same = F.col("label").eqNullSafe(F.col("_label"))
    often = rows.join(F.broadcast(common), same).drop("_label")
    seldom = rows.join(F.broadcast(common.select("_label")), same, "left_anti").join(rare, same).drop("_label")
    return often.unionByName(seldom)


def compress(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row with a usable vector.

    Rows whose vector is null, or holds a null or a value that isn't finite, are left out, as are those with a
    component beyond 2**50, whose whole number 64 bits can't hold. Repeated rows are coded one by one; of an id that
    repeats, the least vector begins an entry; rows without an id begin one (the last) if ids are fewer than entries. Vectors of each
    dimension have codebooks of their own; a dimension that is no multiple of 8 has first parts that are longer by one; an empty vector
    has code 0 and error 0. Fewer rows than entries give as many entries. Errors beyond 64 bits are given as 2**63 - 1.
    Other columns, whatever their names, don't matter. An empty table gives no rows.
    """
    rows = usable(vectors, id, vector, label)
    return with_label_errors(settled(coded(rows, fit_codebooks(rows, rounds)))).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op12_vector_codes(spark, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The rounds one after another, for vectors of one dimension that is a multiple of 8."""
    away = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(w, c)])"
    steps = []
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT n, p, any_value(w) AS w, min({away}) AS away, arg_min(e, {away} * 16 + e) AS e FROM parts JOIN b{r} USING (p) GROUP BY n, p)")
        if r < ROUNDS:
            steps.append(f"""m{r} AS (SELECT p, e, i, sum(w[i]) AS s, count(*) AS k FROM a{r}, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) GROUP BY p, e, i),
l{r} AS (SELECT p, e, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY p, e),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(l.c, b.c) AS c FROM b{r} b LEFT JOIN l{r} l USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, label, [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), parts AS MATERIALIZED (SELECT n, vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS w FROM kept, range({PARTS}) t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, w AS c FROM parts QUALIFY e < {ENTRIES}),
{", ".join(steps)},
ends AS (SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(away) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY n),
mark AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM b{ROUNDS}, LATERAL (SELECT unnest(c) AS x, generate_subscripts(c, 1) AS i))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN ends USING (n), mark"""


OP12_SQL = _sql()
