"""Operator 5: substring deduplication by difference-cover anchors.

A window is `SIZE` consecutive words of a document. Every word is to go that is covered by
a window whose words also start anywhere else.

Positions whose remainder modulo `PERIOD` is in `COVER` hold an anchor, the hash of the
`ANCHOR` words that start there. COVER is a difference cover: whatever the two places of
a repeated passage, less than PERIOD words into it lies a position that is a cover position
in both. As SIZE = PERIOD + ANCHOR - 1, that anchor lies wholly inside any repeated window,
so only windows around a repeated anchor can be repeated.

Anchors meet by hash, in one shuffle that Spark sorts. Each comes with the hash of all words that
windows around it may cover, its surroundings. Where these are equal too, all those windows
are repeated, and nothing more is to be done: so inside of copies and of long passages. Only
where one anchor has several surroundings, as near the ends of a passage, one of each
extends to its windows, which are hashed to 128 bits and meet in a second shuffle.

What a task sees twice is settled there, and one of it goes to the others. A passage that a
third of all documents share thus sends one entry for each block of a task, at most. Of an anchor
with more than `KINDS` surroundings in a block, as in a phrase that many documents hold
amid different words, two go to the others, so that these learn of several; the rest needn't
meet anything to know that they extend to their windows.
Texts are shuffled once, compressed, to meet what was found in them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .shared import carried, restored, widened
from .textops import Slice, mix, pieces_of, ragged, slices, windows

SIZE, PERIOD, ANCHOR = 35, 21, 15
#: Words before an anchor that its windows may cover; words that they may cover together.
REACH, AROUND = PERIOD - 1, SIZE + PERIOD - 1
#: Bits of an anchor's hash that aren't sent; anchors only say where to look.
ANCHOR_SHIFT = np.uint64(16)
#: A perfect difference set modulo 21.
COVER = (0, 1, 4, 14, 16)
_IS_COVER = np.isin(np.arange(PERIOD), COVER)
#: Hashes that a task merges at once.
BLOCK = 1 << 18
#: Surroundings of one anchor that a block sends on to where the anchor meets others.
KINDS = 16
#: Rows whose compressed texts are spread out at once; bytes of text in a batch.
ROWS, BATCH_BYTES = 256, 1 << 20
#: What an entry is: seen once, one that stands for several, or rows of 64 places (as bits, in `more`) that are settled or extend in any case.
ONCE, SEVERAL, SETTLED, ASKING = 0, 1, 2, 3
ENTRY = "key long, more long, _doc long, place long"


def _marks(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in documents as rows of 64 places: doc, block, bits."""
    if not len(doc):
        return doc, at, np.zeros(0, np.uint64)
    block = at >> 6
    order = np.lexsort((block, doc))
    doc, block, bit = doc[order], block[order], (np.uint64(1) << (at[order] & 63).astype(np.uint64))
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (block[1:] != block[:-1])))
    return doc[first], block[first], np.bitwise_or.reduceat(bit, first)


def merged(key: np.ndarray, more: np.ndarray, doc: np.ndarray, at: np.ndarray, kinds: int | None = None) -> pa.RecordBatch:
    """What a block of entries sends on: each kind once; what it stands for is settled, and travels under a key of its own.

    Where a key has more than `kinds` kinds, those after its second ask, and travel so too.
    place is 4 times the place in the document (of marks: of the row of 64) and what the entry is.
    """
    order = np.lexsort((at, doc, more, key))
    key, more, doc, at = key[order], more[order], doc[order], at[order]
    new_key = np.append(True, key[1:] != key[:-1])
    new = new_key.copy()
    new[1:] |= more[1:] != more[:-1]
    first = np.flatnonzero(new)
    several = np.diff(first, append=len(key)) > 1
    heads = np.flatnonzero(new_key[first])
    of_key = np.diff(heads, append=len(first))
    number = np.arange(len(first)) - np.repeat(heads, of_key)
    apart = (number > 1) & (np.repeat(of_key, of_key) > kinds) if kinds else np.zeros(len(first), bool)
    sent, settled, asking = first[~apart], ~new, np.zeros(len(key), bool)
    settled[first[apart & several]] = asking[first[apart]] = True
    columns = [(key[sent], more[sent], doc[sent], at[sent] * 4 + np.where(several[~apart], SEVERAL, ONCE))]
    for marked, what in (settled, SETTLED), (asking, ASKING):
        docs, blocks, bits = _marks(doc[marked], at[marked])
        columns.append((mix(docs.view(np.uint64) ^ mix(blocks.astype(np.uint64))), bits, docs, blocks * 4 + what))
    keys, mores, docs, places = map(np.concatenate, zip(*columns, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (keys.view(np.int64), mores.view(np.int64), docs, places)], ["key", "more", "_doc", "place"])


def _in_blocks(found, block: int, kinds: int | None = None):
    """Arrays (key, more, doc, at), merged a block at a time."""
    held, size = [], 0
    for x in found:
        held.append(x)
        size += len(x[0])
        if size >= block:
            yield merged(*map(np.concatenate, zip(*held, strict=True)), kinds)
            held, size = [], 0
    if size:
        yield merged(*map(np.concatenate, zip(*held, strict=True)), kinds)


def _anchors(batches, block: int, kinds: int):
    def found():
        for batch in batches:
            docs = batch.column("_doc").to_numpy()
            for part in slices(batch.column("text")):
                doc, sizes = part.doc_of_word(), np.diff(part.word_offsets)
                place = np.arange(len(doc)) - part.word_offsets[doc]
                at = np.flatnonzero(_IS_COVER[place % PERIOD] & (place + ANCHOR <= sizes[doc]) & (sizes[doc] >= SIZE))
                if len(at):  # the ends of a document show in the surroundings as words that are none
                    padded = np.zeros(len(doc) + 2 * REACH * len(sizes), np.uint64)
                    where = np.arange(len(doc)) + REACH * (2 * doc + 1)
                    padded[where] = part.words
                    own, around = windows(padded, ANCHOR, AROUND)
                    yield own[where[at]] >> ANCHOR_SHIFT, around[where[at] - REACH], docs[part.lo + doc[at]], place[at]

    return _in_blocks(found(), block, kinds)


def _met(entries: DataFrame) -> DataFrame:
    """The entries with `twice` (does it occur anywhere else?), and `asks`: is it the one of its kind to extend?

    Of entries with one key and several values of `more`, the first with each value asks; ASKING marks do in any case.
    """
    rows = entries.repartition("key").sortWithinPartitions("key", "more", "_doc", "place")
    within = W.partitionBy("key").orderBy("more", "_doc", "place")
    whole = within.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before, after = F.lag("more").over(within).eqNullSafe(F.col("more")), F.lead("more").over(within).eqNullSafe(F.col("more"))
    several = F.first("more").over(whole) != F.last("more").over(whole)
    seen = rows.select("_doc", "more", F.expr("shiftright(place, 2)").alias("at"), F.expr("place & 3").alias("what"), before.alias("before"), after.alias("after"), several.alias("several"))
    marks = F.col("what") >= SETTLED
    asks = F.when(marks, F.col("what") == ASKING).otherwise(F.col("several") & ~F.col("before"))
    twice = F.when(marks, F.col("what") == SETTLED).otherwise((F.col("what") == SEVERAL) | F.col("before") | F.col("after"))
    block, bits = F.when(marks, F.col("at")).otherwise(F.expr("shiftright(at, 6)")), F.when(marks, F.col("more")).otherwise(F.expr("shiftleft(1L, cast(at & 63 as int))"))
    return seen.select("_doc", block.cast("int").alias("block"), bits.alias("bits"), twice.alias("twice"), asks.alias("asks"))


def _by_document(marks: DataFrame, *kinds: str) -> DataFrame:
    """_doc and its rows of 64 places, each kind of mark as bits."""
    bits = [F.bit_or(k).alias(k) for k in kinds]
    return marks.repartition("_doc").groupBy("_doc", "block").agg(*bits).groupBy("_doc").agg(F.collect_list(F.struct("block", *kinds)).alias("_" + kinds[0]))


def _squeezed(batches):
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in (rows for whole in batches for rows in pieces_of(whole, limit=BATCH_BYTES)):
        at = batch.schema.get_field_index("text")
        small = [squeeze.compress(part.buf[i:j]) for part in slices(batch.column(at)) for i, j in zip(part.offsets[:-1], part.offsets[1:], strict=True)]
        yield batch.set_column(at, "text", pa.array(small, pa.binary()))


def _few(batches):
    """Batches of a few rows, as their texts are about to be spread out."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            yield batch.slice(i, ROWS)


def _texts(batch) -> pa.Array:
    spread = zstandard.ZstdDecompressor()
    texts = [spread.decompress(x.as_buffer()) for x in batch.column("text")]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(b"".join(texts)))


def _places(marks: pa.Array, kind: str, part: Slice) -> np.ndarray:
    """The marked words of a slice."""
    marks = marks.slice(part.lo, part.hi - part.lo)
    sizes = np.where(marks.is_valid().to_numpy(zero_copy_only=False), np.diff(marks.offsets.to_numpy()), 0)
    flat = marks.flatten()
    bits = flat.field(kind).to_numpy(zero_copy_only=False).astype(np.int64)
    row, bit = np.nonzero(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")) if len(bits) else (np.zeros(0, int),) * 2
    doc = np.repeat(np.arange(part.hi - part.lo), sizes)[row]
    return part.word_offsets[doc] + flat.field("block").to_numpy(zero_copy_only=False).astype(np.int64)[row] * 64 + bit


def _starts(part: Slice, anchors: np.ndarray) -> np.ndarray:
    """Is the word the start of a window, within its document, around one of the anchors?"""
    n = part.word_offsets[-1]
    change = np.zeros(n + 1, np.int64)
    doc = part.doc_of_word()[anchors]
    lo, hi = np.maximum(anchors - REACH, part.word_offsets[doc]), np.minimum(anchors, part.word_offsets[doc + 1] - SIZE)
    np.add.at(change, lo, 1)
    np.add.at(change, hi + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _windows(batches, block: int):
    def found():
        for batch in _few(batches):
            docs = batch.column("_doc").to_numpy()
            for part in slices(_texts(batch)):
                at = np.flatnonzero(_starts(part, _places(batch.column("_twice"), "asks", part)))
                if len(at):
                    (first,), (second,), doc = windows(part.words, SIZE), windows(part.words_2, SIZE), part.doc_of_word()[at]
                    yield first[at], second[at], docs[part.lo + doc], at - part.word_offsets[doc]

    return _in_blocks(found(), block)


def _cut(batches):
    for batch in _few(batches):
        texts, totals, gone = [], [], []
        for part in slices(_texts(batch)):
            start = _starts(part, _places(batch.column("_twice"), "twice", part))
            start[_places(batch.column("_start"), "start", part)] = True
            change = np.zeros(len(start) + SIZE, np.int64)
            change[: len(start)] += start
            change[SIZE:] -= start
            out = np.cumsum(change[: len(start)]) > 0
            n_gone = part.per_doc(out, part.word_offsets)
            keep = np.ones(len(part.buf), bool)
            if n_gone.any():  # a word goes with what parts it from the next one
                starts = part.spans[0]
                nexts = np.append(starts[1:], len(part.buf))
                nexts = np.minimum(nexts, part.offsets[1:][part.doc_of_word()])
                keep[ragged(starts[out], nexts[out] - starts[out])] = False
            sums = np.concatenate([[0], np.cumsum(keep)])[part.offsets]
            body = part.buf[keep]
            texts.append(pa.LargeStringArray.from_buffers(part.hi - part.lo, pa.py_buffer(sums.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(body))))
            totals.append(np.diff(part.word_offsets))
            gone.append(n_gone)
        join = lambda x: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64))
        text = pa.concat_arrays([pa.array([], pa.large_string()), *texts]).cast(pa.string())
        yield pa.RecordBatch.from_arrays([batch.column("_own"), text, join(totals), join(gone)], ["_own", "text", "n_words", "n_removed"])


def _identity(docs: DataFrame) -> Column:
    """What tells rows apart: doc_id where it is distinct, else a 64-bit hash of doc_id and text."""
    ids = docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count("*").alias("n"))
    most = ids.agg(F.max("n"), F.max(F.col("doc_id").isNull())).first()
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0)) if most[0] in (None, 1) and not most[1] else F.xxhash64("text", F.col("doc_id").cast("long"))


def _rows(docs: DataFrame) -> DataFrame:
    """A row for each of docs: its other columns in `_own`, the text without repeats, n_words, n_removed."""
    block, kinds = BLOCK, KINDS  # tasks get these values; they don't look them up themselves
    of = _identity(docs)
    docs = docs.select(of.alias("_doc"), *carried(docs, "text"))
    small = StructType([StructField(f.name, BinaryType() if f.name == "text" else f.dataType, f.name != "_doc") for f in docs.schema])  # _doc can't be null: both joins below then want the very same rows, so Spark shuffles the texts once
    texts = docs.mapInArrow(_squeezed, small).repartition("_doc")
    anchors = _met(docs.select("_doc", "text").mapInArrow(lambda batches: _anchors(batches, block, kinds), ENTRY)).where(F.col("twice") | F.col("asks"))
    bits = lambda kind: F.when(F.col(kind), F.col("bits")).otherwise(F.lit(0)).cast("long").alias(kind)
    near = _by_document(anchors.select("_doc", "block", bits("twice"), bits("asks")), "twice", "asks")
    asking = texts.join(near.where(F.exists("_twice", lambda x: x["asks"] != 0)), "_doc")
    starts = _met(asking.mapInArrow(lambda batches: _windows(batches, block), ENTRY)).where("twice")
    found = texts.join(near, "_doc", "left").join(_by_document(starts.select("_doc", "block", F.col("bits").alias("start")), "start"), "_doc", "left")
    return found.mapInArrow(_cut, widened(StructType([docs.schema["_own"]]), "text string, n_words long, n_removed long"))


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with the repeated windows' words cut from text, n_words (before) and n_removed.

    A null text has no words and becomes empty. Equal rows, and rows of one doc_id, null too,
    are documents of their own and copies of each other where their texts are equal. Any length
    of text works; one long text is handled in one task. Columns named n_words or n_removed are replaced.
    """
    docs = docs.drop("n_words", "n_removed")
    rows = _rows(docs)
    return rows.select(*restored(docs, text=F.col("text")), "n_words", "n_removed")


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spaced = F.regexp_replace(F.translate("text", "\t\n\x0b\x0c\r", "     "), " +", " ")
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.trim(spaced), 256).alias("kept_sha256"))


def cut_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without repeated passages; n_chars follows the text. All other columns stay as they are."""
    rows = _rows(docs)
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kept = F.col("_own").getField("n_chars")
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(kept).cast(docs.schema["n_chars"].dataType)
    return rows.select(*restored(docs, **new))


OP5_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {SIZE - 1}], ' ')) AS k FROM (SELECT *, unnest(generate_series(1, len(ws) - {SIZE - 1})) AS i FROM w)),
r AS (SELECT doc_id, i FROM s QUALIFY count(*) OVER (PARTITION BY k) > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(i, i + {SIZE - 1})) AS p FROM r) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
flat AS (SELECT DISTINCT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.p) AS t, count(*) AS n FROM word ANTI JOIN flat USING (doc_id, p) GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
