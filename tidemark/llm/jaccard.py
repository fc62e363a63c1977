"""Operator 6: n-gram Jaccard join by a MinHash LSH forest.

Shingles are `SHINGLE` consecutive words (all words of a shorter text). Documents of one
shingle set are one class, whatever their number; the join works on one text of each class.

Every class has a path of `DEPTH` minima in each of `TREES` trees; sorted by path, these are prefix
tries. Classes under one node of a trie share a prefix. The join begins at the full
depth and compares, under each node, classes that aren't connected yet by the share of all
their minima that agree; those likely to be similar become connected. From the likeness of what was
found follows what part of all links has been: a link of similarity s meets at depth d with
probability 1 - (1 - s**d)**TREES. While that estimate is below the target, prefixes
are shortened to the longest that should reach it. Nodes whose classes are all connected
already, as in large groups of near copies, are not looked at again, and a node with more than `NODE`
classes is dealt into blocks; so work follows what is yet unknown, not the size of groups.

Connected classes are then verified exactly: their shingle sets meet in groups of bounded size (a large
cluster is dealt into blocks, and each pair of blocks is a group), where whole matrices
of intersections are counted. A group sends on, for each class, the number of its links and
one link of a spanning forest, so no pair is ever a row, and every link is counted. Only
verified links make the result's classes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import carried, column, restored, settled, stored
from .textops import joined, mix, slices, windows

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 24, 8, 0.999999
#: Classes are taken for similar from this share below the threshold on; 192 minima give it within 0.03, so this is six times that.
MARGIN = 0.18
#: Classes of a trie's node that are compared in one group; rows of a group of small nodes.
NODE, ROWS = 512, 4096
#: Classes, and shingles, on one side of a verifying group; shingles whose columns are multiplied at once.
BLOCK, SHINGLES, COLUMNS = 384, 1 << 19, 4096
#: A class of equal texts that holds more than this share of the rows is joined by broadcast; so there are at most 10,000 of these.
HEAVY = 10_000
_rng = np.random.default_rng(61)
_FLIP = _rng.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_TURN = _rng.integers(0, 2**31, TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_OTHER = np.uint64(0xA0761D6478BD642F)


def met(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that two classes share a prefix of this length in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(links: list[tuple[float, int]], depth: int, threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix, up to `depth`, that should find the share `recall` of all links.

    links: similarities of those found at `depth`, with their numbers. Each stands for as many
    as it takes to find one; one more at the threshold is assumed.
    """
    alike = [(min(1.0, max(threshold, s)), n) for s, n in links] + [(threshold, 1)]
    whole = [(s, n / met(s, depth)) for s, n in alike]
    total, now = sum(n for _, n in whole), depth
    while now > 1 and sum(n * met(s, now) for s, n in whole) < recall * total:
        now -= 1
    return now


def shingle_sets(part):
    """Of each document of a slice, its sorted distinct shingle hashes."""
    (hashes,) = windows(part.words, SHINGLE)
    bounds = part.word_offsets
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= SHINGLE:
            yield np.unique(hashes[lo : hi - SHINGLE + 1])
        elif hi > lo:
            yield joined(windows(part.words[lo:hi], hi - lo)[0], np.array([hi - lo], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def path(shingles: np.ndarray) -> bytes:
    """The minima of all trees, one after another, eight bits of each."""
    short, least = (shingles >> np.uint64(32)).astype(np.uint32), np.full(TREES * DEPTH, 2**32 - 1, np.uint32)
    for i in range(0, len(short), 1024):
        least = np.minimum(least, ((short[i : i + 1024, None] ^ _FLIP) * _TURN).min(0))
    return (mix(least.astype(np.uint64)) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sketch(batches):
    for batch in batches:
        first, second, paths, sizes = [], [], [], []
        for part in slices(batch.column("text")):
            for s in shingle_sets(part):
                with np.errstate(over="ignore"):
                    first.append(mix(s).sum(dtype=np.uint64))
                    second.append(mix(s ^ _OTHER).sum(dtype=np.uint64))
                paths.append(path(s) if len(s) else None)
                sizes.append(len(s))
        long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_id"), batch.column("_tag"), long(first), long(second), pa.array(sizes, pa.int64()), pa.array(paths, pa.binary())], ["doc_id", "_id", "_tag", "set_1", "set_2", "shingles", "path"])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n things with links, the least that each is connected to."""
    root = np.arange(n)
    while len(i):
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


def _compare(likely: float):
    """Under each node, links between things not connected yet: for each, the least that it becomes connected to, and its best likeness."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, i, j, side, comp = (table.column(c).to_numpy() for c in ("key", "i", "j", "side", "comp"))
        order = np.lexsort((side, j, i, key))
        key, i, j, side, comp = key[order], i[order], j[order], side[order], comp[order]
        minima = np.frombuffer(b"".join(table.column("path").to_pylist()), np.uint8).reshape(-1, TREES * DEPTH)[order]
        new = np.append(True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        node = np.cumsum(new) - 1
        names, thing = np.unique(comp, return_inverse=True)
        a, b, alike = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)]
        at, step = np.arange(len(key)), 0
        while len(at):
            step += 1
            at = at[at + step < len(key)]
            at = at[node[at] == node[at + step]]
            use = at[(thing[at] != thing[at + step]) & ((i[at] == j[at]) | (side[at] != side[at + step]))]
            share = (minima[use] == minima[use + step]).mean(1)
            good = share >= likely
            a.append(thing[use[good]])
            b.append(thing[use[good] + step])
            alike.append(share[good])
        a, b, alike = map(np.concatenate, (a, b, alike))
        root, best = _roots(len(names), a, b), np.zeros(len(names))
        np.maximum.at(best, a, alike)
        np.maximum.at(best, b, alike)
        found = np.flatnonzero(best)
        return pa.table({"a": pa.array(names[found]), "b": pa.array(names[root[found]]), "alike": pa.array(best[found])})

    return run


def _keyed(classes: DataFrame, depth: int) -> DataFrame:
    """node, comp and the key of each trie node of this depth that the class is under."""
    keys = [F.xxhash64(F.lit(t), F.substring("path", t * DEPTH + 1, depth)) for t in range(TREES)]
    return classes.select("node", "comp", F.explode(F.array(*keys)).alias("key"))


def _links(members: DataFrame, classes: DataFrame, likely: float) -> DataFrame:
    """What `_compare` finds in the groups of members: node, comp, key, group, i, j, side."""
    return stored(members.join(classes.select("node", "path"), "node").groupBy("group").applyInArrow(_compare(likely), "a long, b long, alike double"))


def _merged(classes: DataFrame, links: DataFrame, well: bool) -> DataFrame:
    """classes whose comp is the least of those it is linked to: near enough to components to spare comparisons. well: look four links far."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    to = stored(both.groupBy("a").agg(F.min("b").alias("to")).select("a", F.least("a", "to").alias("to")))
    if well:
        over = both.join(to.withColumnsRenamed({"a": "b"}), "b").groupBy("a").agg(F.min("to").alias("far"))
        to = stored(to.join(over, "a").select("a", F.least("to", "far").alias("to")))
        jump = to.select(F.col("a").alias("to"), F.col("to").alias("far"))
        to = stored(to.join(jump, "to", "left").select("a", F.coalesce("far", "to").alias("to")))
    return settled(classes.join(to.withColumnRenamed("a", "comp"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"), "path"))


def _within_nodes(classes: DataFrame, depth: int, likely: float) -> tuple[DataFrame, list[DataFrame]]:
    """classes with what is found at this depth, and its links: each node's classes are compared, in blocks if they are many."""
    nodes = _keyed(classes, depth).groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n"))
    nodes = stored(nodes.where("lo != hi").select("key", "n"))
    size, most = nodes.agg(F.sum("n"), F.max("n")).first()
    if not size:
        return classes, []
    block, small = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / NODE)), F.col("n") <= NODE
    group = F.when(small, F.pmod(F.xxhash64("key"), F.lit(max(1, size // ROWS)))).otherwise(F.xxhash64("key", "block"))
    dealt = _keyed(classes, depth).join(nodes, "key").withColumn("block", F.when(small, F.lit(0)).otherwise(block).cast("int"))
    links = [_links(dealt.select("node", "comp", "key", group.alias("group"), F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")), classes, likely)]
    classes = _merged(classes, links[0], most > NODE)
    if most > NODE:
        more = _between_blocks(classes, nodes.where(F.col("n") > NODE).select("key"), depth, likely)
        if more is not None:
            classes, links = _merged(classes, more, True), [*links, more]
    return classes, links


def _between_blocks(classes: DataFrame, large: DataFrame, depth: int, likely: float) -> DataFrame | None:
    """Links between the blocks of large nodes. The largest connected part of a node isn't compared with itself."""
    members = settled(_keyed(classes, depth).join(large, "key"))
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("n"))
    nodes = parts.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("home"), F.sum("n").alias("n")).where(F.col("home.n") < F.col("n"))
    nodes = stored(nodes.select("key", F.col("home.comp").alias("home"), F.ceil(F.col("home.n") / NODE).cast("int").alias("h"), F.ceil((F.col("n") - F.col("home.n")) / NODE).cast("int").alias("o")))
    if nodes.isEmpty():
        return None
    at_home, any_block = F.col("comp") == F.col("home"), F.xxhash64("node", "key")
    block = F.when(at_home, F.pmod(any_block, F.col("h"))).otherwise(F.col("h") + F.pmod(any_block, F.col("o"))).cast("int")
    meets = F.explode(F.sequence(F.when(at_home, F.col("h")).otherwise(F.lit(0)), F.col("h") + F.col("o") - 1))
    dealt = members.join(nodes, "key").withColumn("block", block).select("node", "comp", "key", "block", meets.alias("other"))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return _links(dealt.select("node", "comp", "key", F.xxhash64("key", i, j).alias("group"), i.alias("i"), j.alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side")), classes, likely)


def clusters(classes: DataFrame, threshold: float) -> DataFrame:
    """node and comp of those classes (node, path) that may be linked to another: then they are in one comp."""
    now, depth, likely, alike, links = settled(classes.select("node", F.col("node").alias("comp"), "path")), DEPTH, threshold - MARGIN, [], []
    while True:
        now, found = _within_nodes(now, depth, likely)
        for x in found:
            links.append(x.select("a", "b"))
            near = x.where(F.col("alike") >= threshold - MARGIN / 6).groupBy(F.round("alike", 2).alias("s")).agg(F.count("*").alias("n"))
            alike += [(r["s"], r["n"]) for r in near.collect()]  # some 20 rows
        shorter = shortened(alike, depth, threshold)
        if shorter == depth:
            break
        depth = shorter
    none = classes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    return components(functools.reduce(DataFrame.union, links, none)).withColumnRenamed("root", "comp")


def _intersections(a: list[np.ndarray], b: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of sets: of all in a with all in b (b None: with a)."""
    sets = a + (b or [])
    if len(sets) <= 4:
        rest = b or a
        return np.array([[np.intersect1d(x, y, assume_unique=True).size for y in rest] for x in a])
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column = np.unique(flat, return_inverse=True)
    shared = np.bincount(column, minlength=len(values)) > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    row, column = row[use], number[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(a), len(b) if b is not None else len(a)), np.float32)
    for lo in range(0, int(shared.sum()), COLUMNS):
        i, j = np.searchsorted(column, [lo, lo + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[i:j], column[i:j] - lo] = 1
        out += m[: len(a)] @ (m[len(a) :] if b is not None else m).T
    return out

def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sets = [s for part in slices(table.column("text")) for s in shingle_sets(part)]
        nodes, cluster, i, j, side, copies = (table.column(c).to_numpy() for c in ("node", "cluster", "i", "j", "side", "copies"))
        out: dict[str, list] = {"node": [], "links": [], "root": [], "parted": []}
        parted = table.column("parted").to_numpy(zero_copy_only=False)
        order = np.lexsort((nodes, j, i, cluster))
        for rows in np.split(order, np.flatnonzero(np.diff(cluster[order]) | np.diff(i[order]) | np.diff(j[order])) + 1):
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            cross = len(right) > 0
            if cross:
                rows = np.concatenate([left, right])
            own = [sets[k] for k in rows]
            sizes, k = np.array([len(s) for s in own]), len(left)
            both = _intersections(own[:k], own[k:]) if cross else _intersections(own, None)
            whole = sizes[:k, None] + sizes[None, k:] - both if cross else sizes[:, None] + sizes[None, :] - both
            near = both >= threshold * whole - 1e-9
            if not cross:
                np.fill_diagonal(near, False)
            weight = copies[rows]
            links = np.concatenate([near @ weight[k:], near.T @ weight[:k]]) if cross else near @ weight
            a, b = np.nonzero(near)
            names, rank = np.unique(nodes[rows], return_inverse=True)
            root = _roots(len(names), rank[a], rank[b + k if cross else b])
            out["node"] += nodes[rows].tolist()
            out["links"] += links.tolist()
            out["root"] += names[root[rank]].tolist()
            out["parted"] += parted[rows].tolist()
        return pa.table({c: pa.array(v, pa.bool_() if c == "parted" else pa.int64()) for c, v in out.items()})

    return run


def _named(docs: DataFrame, id: str = "doc_id") -> DataFrame:
    """docs with `_id` and `_tag`, which tell different rows apart: the id, null as a number, and 64 bits of the text."""
    return docs.withColumns({"_id": F.coalesce(F.col(id).cast("long"), F.lit(-(2**63))), "_tag": F.xxhash64("text", F.col(id).isNull())})


class Joined:
    """The join of docs (doc_id, text), worked out: a row for each class in `labels`, for each document in `sketch`."""

    def __init__(self, docs: DataFrame, threshold: float):
        rows = _named(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
        self.sketch = settled(rows.mapInArrow(_sketch, "doc_id long, _id long, _tag long, set_1 long, set_2 long, shingles long, path binary"))
        self.known = self.sketch.where(F.col("path").isNotNull())
        ids = self.known.groupBy("_id").agg(F.count("*").alias("n"), F.min("_tag").alias("lo"), F.max("_tag").alias("hi"))
        self.rows, repeats, mixed, null = ids.agg(F.sum("n"), F.max("n"), F.max(F.col("lo") != F.col("hi")), F.min("_id")).first()
        self.repeated, plain = bool(repeats and repeats > 1), not mixed and null != -(2**63)  # plain: an id names one text
        if self.repeated:  # one row of each, before the shuffle too
            rows = rows.groupBy("_id", "_tag").agg(F.first("text").alias("text"))

        classes = self.known.groupBy("set_1", "set_2").agg(F.min(F.struct("_id", "_tag")).alias("who"), F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.first("path").alias("path"), F.first("shingles").alias("shingles"))
        node = F.col("doc") if plain else F.xxhash64("set_1", "set_2")
        classes = settled(classes.select("set_1", "set_2", "who._id", "who._tag", "doc", node.alias("node"), "copies", "shingles", "path"))
        found, parted = self._verified(rows, classes, settled(clusters(classes.select("node", "path"), threshold)), threshold)
        linked = found.groupBy("node").agg(F.sum("links").alias("links"))
        whole = found.where(~F.col("parted")).groupBy("node").agg(F.min("root").alias("root"))  # of clusters in one group
        roots = components(found.where("parted").select(F.col("node").alias("a"), F.col("root").alias("b"))).union(whole) if parted else whole
        labels = classes.drop("path", "shingles").join(linked, "node", "left").join(roots, "node", "left")
        labels = settled(labels.select("set_1", "set_2", "_id", "_tag", "doc", "node", "copies", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
        if plain:
            self.labels = labels.withColumn("class_id", F.col("root"))
        else:
            names = settled(labels.groupBy("root").agg(F.min("doc").alias("class_id")))  # kept, so that Spark can split a hot root's partition in the join
            self.labels = settled(labels.join(names, "root"))

    @staticmethod
    def _verified(rows: DataFrame, classes: DataFrame, comps: DataFrame, threshold: float) -> tuple[DataFrame, bool]:
        size = classes.select("node", "_id", "_tag", "copies", "shingles").join(comps, "node")
        sizes = size.groupBy("comp").agg(F.count("*").alias("size"), F.sum("shingles").alias("sum")).where(F.col("size") > 1)
        sizes = settled(sizes.select("comp", F.ceil(F.greatest(F.col("size") / BLOCK, F.col("sum") / SHINGLES)).cast("int").alias("blocks"), "size", "sum"))
        n, total, most = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("sum"), F.lit(0)), F.coalesce(F.max("blocks"), F.lit(0))).first()
        texts = rows.join(size.join(sizes, "comp"), ["_id", "_tag"])
        placed = texts.select("node", "text", "copies", F.col("comp").alias("cluster"), "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
        meets = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        i, j, small = F.least("block", "other"), F.greatest("block", "other"), F.col("blocks") == 1
        dealt = placed.select("*", meets.alias("other")).select(
            "node", "text", "copies", "cluster", (~small).alias("parted"), i.alias("i"), j.alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"),
            F.when(small, F.pmod(F.xxhash64("cluster"), F.lit(max(1, n // BLOCK, total // SHINGLES)))).otherwise(F.xxhash64("cluster", i, j)).alias("group"),
        )
        return settled(dealt.groupBy("group").applyInArrow(_verify(threshold), "node long, links long, root long, parted boolean")), most > 1

    def documents(self) -> DataFrame:
        """doc_id, class_id, n_links of every row."""
        labels, own = self.labels.select("set_1", "set_2", "class_id", "n_links"), ["set_1", "set_2"]
        heavy = F.col("copies") * HEAVY > (self.rows or 0)
        few, rest = self.labels.where(heavy).select(*own, "class_id", "n_links"), self.labels.where(~heavy).select(*own, "class_id", "n_links")
        named = self.known.join(F.broadcast(few), own).unionByName(self.known.join(F.broadcast(few.select(*own)), own, "left_anti").join(rest, own))
        alone = self.sketch.where(F.col("path").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
        return named.select("doc_id", "class_id", "n_links").union(alone)

    def staying(self) -> DataFrame:
        """_id and _tag of one row of each class, and of every row without words."""
        one = self.labels.where(F.col("node") == F.col("root")).select("_id", "_tag")
        return one.union(self.sketch.where(F.col("path").isNull()).select("_id", "_tag").distinct())


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each of docs: doc_id, class_id, n_links.

    class_id is the least doc_id among the documents joined to it by links, n_links the
    number of other documents whose Jaccard similarity with it is at least `threshold`,
    equal texts included. Every row is a document: rows that repeat one are copies of it, and
    rows of one doc_id with different texts are judged each by its own. Rows with a null
    doc_id take part too; a class of nothing else has a null class_id. A document without
    words (null, empty, blank) has no shingles: it is a class of its own with no links. Any
    length of text works; one long text is handled in one task.
    """
    return Joined(docs, threshold).documents()


def op6_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def drop_near(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class one row, that of the least doc_id where an id names one text; others go.

    Rows without words all stay. Of rows with one doc_id and one text any one stays. The
    columns stay as they are, whatever their names.
    """
    found = Joined(docs, THRESHOLD)
    rows = _named(docs.select(*carried(docs, "text"), column("doc_id").alias("_doc_id")), "_doc_id").drop("_doc_id")
    if found.repeated:
        blank = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        rows = rows.where(~blank).dropDuplicates(["_id", "_tag"]).unionByName(rows.where(blank))
    return rows.join(found.staying(), ["_id", "_tag"], "left_semi").select(*restored(docs, text=F.col("text")))


OP6_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + {SHINGLE - 1}], ' ')) AS k
      FROM (SELECT *, unnest(generate_series(1, greatest(1, len(ws) - {SHINGLE - 1}))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM s a JOIN s b USING (k) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM b JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 10 * b.n >= {round(10 * THRESHOLD)} * (nx.n + ny.n - b.n)),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.doc_id)
SELECT r.doc_id, min(root) AS class_id, (SELECT count(*) FROM l WHERE l.x = r.doc_id) AS n_links FROM r GROUP BY r.doc_id
"""
