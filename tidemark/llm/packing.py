"""Operator 7: packing.

Documents become token ids and are packed into sequences of at most `capacity` tokens.
Each task packs its own rows in blocks of whole documents: sequences' costs are estimated
as linear plus quadratic (attention) in the length of each piece; documents go, longest
first, to the sequence of lowest cost that has room for them. Only a document for which none
of the block's sequences has room is cut, to fill the one of lowest cost.
The room of a block is exactly what its tokens need, so all its sequences end full but
one, which stays open for the next block. What a task leaves open at its end is dealt
into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import heapq
import os

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import Slice, WordMemo, ragged, slices

CAPACITY, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / CAPACITY
BLOCK_BYTES = 2 << 20
#: Distinct units that a worker remembers.
MEMO_WORDS = 500_000
_memos: dict[str, WordMemo] = {}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[97:123] = True
_MARK[[c for c in range(33, 127) if not chr(c).isalnum() and c != ord("'")]] = True


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def word_memo(path: str) -> WordMemo:
    """Ids of words by the tokenizer file. White space ends every token of it, so a text's ids are its words' ids."""
    if path not in _memos:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        _memos[path] = WordMemo(lambda words: [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)], MEMO_WORDS)
    return _memos[path]


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


class Packer:
    """Packs blocks of documents, given by their numbers of tokens, one after another."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.next = 0
        self.open: list = []  # of the open sequence: cost, number, tokens in it
        self.tail: list = []  # its pieces: (document key, start, length)

    def block(self, lengths: list[int], keys: list) -> list[tuple]:
        """(key, start, length, sequence, offset) of every piece whose sequence is full."""
        cap, done, rest = self.capacity, [], []
        for key, n in zip(keys, lengths, strict=True):
            whole = n // cap
            for i in range(whole):
                done.append((key, i * cap, cap, self.next, 0))
                self.next += 1
            if n % cap:
                rest.append((n % cap, whole * cap, key))
        rest.sort(key=lambda x: -x[0])
        total = sum(x[0] for x in rest) + (self.open[2] if self.open else 0)
        count = -(-total // cap)
        names, tails = ([self.open[1]], [self.tail]) if self.open else ([], [])
        new = count - len(names)
        names, tails = names + list(range(self.next, self.next + new)), tails + [[] for _ in range(new)]
        self.next += new
        costs, room = np.zeros(count), np.full(count, cap)
        if self.open:
            costs[0], room[0] = self.open[0], cap - self.open[2]
        if count:
            room[-1] -= count * cap - total  # the newest takes what is left over
        heap = [(c, i) for i, c in enumerate(costs.tolist()) if room[i]]
        heapq.heapify(heap)
        for n, start, key in rest:
            while n:
                while heap[0][0] != costs[heap[0][1]] or not room[heap[0][1]]:
                    heapq.heappop(heap)  # an old cost, or full
                at = heap[0][1]
                if room[at] < n:  # not the cheapest: then the cheapest of those with room, if there is one
                    fits = np.flatnonzero(room >= n)
                    at = int(fits[costs[fits].argmin()]) if len(fits) else at
                take = min(n, int(room[at]))
                tails[at].append((key, start, take))
                room[at] -= take
                costs[at] += cost(take)
                heapq.heappush(heap, (float(costs[at]), at))
                start, n = start + take, n - take
        self.open, self.tail = [], []
        for i, (s, own) in enumerate(zip(names, tails, strict=True)):
            if i == count - 1 and total < count * cap:
                self.open, self.tail = [float(costs[i]), s, cap - (count * cap - total)], own
            else:
                done += self._placed(own, s)
        return done

    @staticmethod
    def _placed(own: list, s: int) -> list[tuple]:
        at, out = 0, []
        for key, start, n in own:
            out.append((key, start, n, s, at))
            at += n
        return out

    def finish(self) -> list[tuple]:
        """The pieces of the open sequence, dealt into sequences of power-of-two lengths."""
        if not self.open:
            return []
        left, out, own = self.open[2], [], list(reversed(self.tail))
        s = self.open[1]
        while left:
            size = 1 << (left.bit_length() - 1)
            left, at = left - size, 0
            while at < size:
                key, start, n = own.pop()
                take = min(n, size - at)
                out.append((key, start, take, s, at))
                at += take
                if take < n:
                    own.append((key, start + take, n - take))
            s, self.next = self.next, self.next + 1
        self.open, self.tail = [], []
        return out


SCHEMA = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def units(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans whose ids, one after another, are a text's: the bytes, starts and ends.

    The tokenizer lower-cases, ends tokens at white space and never joins letters to
    punctuation but for an apostrophe's. So ASCII letters can be lower-cased here and words
    cut between an ASCII letter and ASCII punctuation, which leaves far fewer distinct parts.
    Where a special token's text might be meant, words stay whole.
    """
    buf, breaks = part.buf, None
    if b"<|" not in buf.tobytes():
        buf = _LOWER[buf]
        letter, mark = _LETTER[buf], _MARK[buf]
        breaks = np.zeros(len(buf), bool)
        breaks[1:] = (letter[:-1] & mark[1:]) | (mark[:-1] & letter[1:])
    return buf, *part.runs(part.is_word, breaks)


def tokens(texts: pa.Array, path: str):
    """For blocks of documents: the first one's place, ids of all, and each one's number of ids."""
    memo = word_memo(path)
    for part in slices(texts, BLOCK_BYTES):
        buf, firsts, ends = units(part)
        starts, lengths = memo(buf, firsts, ends)
        counts = part.per_doc(lengths, np.searchsorted(firsts, part.offsets))
        flat = memo.ids[ragged(starts, lengths)]
        yield part.lo, np.insert(flat, np.cumsum(counts), END_ID).astype("<u4"), counts + 1


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The pieces of all documents: key, start, length, doc_tokens, sequence_id, offset, ids.

    ids holds a piece's ids as little-endian unsigned 32-bit numbers. A null or empty text
    is one end id. Repeated rows are packed one by one; of documents of equal length the first goes first.
    A text of any length works: a block is at least one whole document. sequence_id carries the number of
    the task, so it is unique in the result; a task that runs again packs alike.
    """
    path = path or tokenizer_path()

    def run(batches):
        packer, base = Packer(capacity), TaskContext.get().partitionId() << 36
        waiting: dict[tuple, tuple] = {}  # documents with pieces in the open sequence
        serial, keys = 0, None

        def rows(placed, blocks):
            placed.sort()
            flat = [blocks[k[0]][k[1] + s : k[1] + s + n].tobytes() for k, s, n, _, _ in placed]
            cols = [pa.array([k[3] for k, *_ in placed], keys)] + [pa.array([x[i] for x in placed], pa.int64()) for i in (1, 2)]
            cols += [pa.array([k[2] for k, *_ in placed], pa.int64()), pa.array([base + x[3] for x in placed], pa.int64()), pa.array([x[4] for x in placed], pa.int64()), pa.array(flat, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, [key, "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

        for batch in batches:
            keys = batch.schema.field(key).type
            names = batch.column(key).to_pylist()
            for lo, ids, counts in tokens(batch.column(text), path):
                serial += 1
                firsts = np.cumsum(counts) - counts
                blocks = waiting | {serial: ids}
                sizes = counts.tolist()
                marks = [(serial, f, n, names[lo + i]) for i, (f, n) in enumerate(zip(firsts.tolist(), sizes, strict=True))]
                done = packer.block(sizes, marks)
                yield rows(done, blocks)
                used = {k[0] for k, _, _ in packer.tail}
                waiting = {}
                if used:  # keep only the ids that the open sequence needs
                    serial += 1
                    kept, at, tail = [], 0, []
                    for k, s, n in packer.tail:
                        kept.append(blocks[k[0]][k[1] + s : k[1] + s + n])
                        tail.append(((serial, at - s, k[2], k[3]), s, n))
                        at += n
                    packer.tail, waiting = tail, {serial: np.concatenate(kept)}
        if waiting:
            yield rows(packer.finish(), waiting)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, {SCHEMA}")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def pack_documents(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: pieces of all documents, with their ids."""
    return pack(docs)
