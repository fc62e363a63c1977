"""Vectorised helpers over the bytes of whole texts.

Every operator that looks at words, lines or n-grams works on slices of an Arrow
string column: one contiguous byte buffer and the offsets of the documents in it.
Words are maximal runs of bytes other than space and ``\\x09-\\x0D``; these are ASCII,
so splitting the UTF-8 bytes splits the text.

Spans are hashed eight bytes at a time, each step mixed into all bits before the next, and
windows of words by joining hashes of halves in the same way. Neither is linear, so texts of
a regular build (repeated or mirrored patterns) collide no more often than any others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes of text handled at once; a longer document makes a slice of its own.
SLICE_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64: spreads the entropy over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers; seeds of two independent hashes.
TURN, TURN_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
FIRST, SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: A longer span is hashed in parts of so many bytes, and then the parts' hashes as a span.
PART_BYTES = 512
_MASKS = np.array([(1 << 8 * r) - 1 for r in range(9)], np.uint64)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: np.uint64 = FIRST) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans of equal bytes have equal hashes wherever they lie."""
    starts = np.asarray(starts, np.int64)
    lengths = np.asarray(ends, np.int64) - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    if lengths.max() > PART_BYTES:
        out, long = np.empty(len(starts), np.uint64), lengths > PART_BYTES
        out[~long] = hash_spans(buf, starts[~long], starts[~long] + lengths[~long], seed)
        n = -(-lengths[long] // PART_BYTES)
        at = np.cumsum(n) - n
        begin = np.repeat(starts[long] - at * PART_BYTES, n) + np.arange(n.sum()) * PART_BYTES
        parts = hash_spans(buf, begin, np.minimum(begin + PART_BYTES, np.repeat(starts[long] + lengths[long], n)), seed)
        out[long] = joined(hash_spans(parts.view(np.uint8), 8 * at, 8 * (at + n), seed), lengths[long].astype(np.uint64))
        return out
    lo = int(starts.min())
    own = np.concatenate([buf[lo : int((starts + lengths).max())], np.zeros(8, np.uint8)])
    eight = np.ndarray(len(own) - 7, "<u8", own, strides=(1,))  # the eight bytes from each place on
    out = mix(lengths.astype(np.uint64) * TURN_2 + seed)
    at, left, live = starts - lo, lengths, None
    while True:
        step = eight[at] & _MASKS[np.clip(left, 0, 8)]
        if live is None:
            out = mix(out * TURN + step)
        else:
            out[live] = mix(out[live] * TURN + step)
        more = np.flatnonzero(left > 8)
        if not len(more):
            return out
        live = more if live is None else live[more]
        at, left = at[more] + 8, left[more] - 8


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs of hashes; their order counts."""
    return mix(a * TURN + b * TURN_2 + SECOND)


def windows(values: np.ndarray, *sizes: int) -> list[np.ndarray]:
    """For each size, a hash of every window of so many values, in order.

    A window is joined from the one of half its length that begins it and the one that ends
    it; these may overlap.
    """
    out: dict[int, np.ndarray] = {}
    now, n = values, 1
    for size in sorted(set(sizes)):
        while 2 * n <= size:
            now, n = joined(now[: max(0, len(now) - n)], now[n:]), 2 * n
        rest = size - n
        out[size] = joined(now[: max(0, len(now) - rest)], now[rest:]) if rest else now
    return [out[size] for size in sizes]


@dataclass
class Slice:
    """Documents lo to hi of a batch: their bytes, and offsets (hi - lo + 1) into these."""

    lo: int
    hi: int
    buf: np.ndarray
    offsets: np.ndarray

    @cached_property
    def is_word(self) -> np.ndarray:
        return ~SEPARATOR[self.buf]

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        return self.runs(self.is_word)

    def runs(self, inside: np.ndarray, breaks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of `inside` bytes, cut at documents and where `breaks` says."""
        n = len(self.buf)
        first, last = np.empty(n, bool), np.empty(n, bool)
        if n:
            first[0] = last[-1] = True
            first[1:], last[:-1] = ~inside[:-1], ~inside[1:]
            cuts = self.offsets[(self.offsets > 0) & (self.offsets < n)]
            first[cuts] = last[cuts - 1] = True
            if breaks is not None:
                first |= breaks
                last[:-1] |= breaks[1:]
        return np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Of each document, the number of words before it; one more at the end."""
        return np.searchsorted(self.spans[0], self.offsets)

    @cached_property
    def words(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return hash_spans(self.buf, *self.spans)

    @cached_property
    def words_2(self) -> np.ndarray:
        """An independent second hash."""
        return hash_spans(self.buf, *self.spans, seed=SECOND)

    @cached_property
    def point_starts(self) -> np.ndarray:
        """Where characters begin: at every byte but those that go on with one."""
        first = (self.buf & 0xC0) != 0x80
        first[self.offsets[:-1][self.offsets[:-1] < len(self.buf)]] = True
        return np.flatnonzero(first)

    @cached_property
    def point_offsets(self) -> np.ndarray:
        """Of each document, the number of characters before it; one more at the end."""
        return np.searchsorted(self.point_starts, self.offsets)

    def points(self, buf: np.ndarray | None = None) -> np.ndarray:
        """The characters of the texts (or of other bytes in their place), as numbers: their bytes, four at most."""
        buf, at = self.buf if buf is None else buf, self.point_starts
        if len(at) == len(buf):
            return buf.astype(np.uint64)
        four = np.ndarray(len(buf), "<u4", np.concatenate([buf, np.zeros(3, np.uint8)]), strides=(1,))
        return four[at] & _MASKS[np.minimum(np.diff(at, append=len(buf)), 4)]

    def per_doc(self, values: np.ndarray, bounds: np.ndarray, cut: int = 0) -> np.ndarray:
        """Sums of values by document, without the last `cut` of each. They don't depend on the other documents, not even in their last digits."""
        lo = np.minimum(bounds[:-1], len(values))
        hi = np.clip(bounds[1:] - cut, lo, len(values))
        if values.dtype.kind == "f":
            return segment_sums(values.astype(np.float64), lo, hi)
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        return sums[hi] - sums[lo]

    def inside(self, size: int, bounds: np.ndarray) -> np.ndarray:
        """For every window start: does the window end in the document where it starts?"""
        n = max(0, bounds[-1] - size + 1)
        ok = np.ones(n, bool)
        for b in range(1, size):
            at = bounds[1:-1] - b
            ok[at[(at >= 0) & (at < n)]] = False
        return ok

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.hi - self.lo), np.diff(self.word_offsets))


def segment_sums(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Of each segment lo to hi, in order and apart, the sum of its values (or rows of values), added up by itself."""
    if not len(lo):
        return np.zeros((0, *values.shape[1:]))
    ends = np.stack([lo, hi], 1).ravel()
    sums = np.add.reduceat(np.concatenate([values, np.zeros_like(values, shape=(1, *values.shape[1:]))]), ends, axis=0)[::2]
    sums[lo == hi] = 0
    return sums


def as_text(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Whole texts, null as empty, in one array with 64-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """A text column as slices of whole documents."""
    column = as_text(column)
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and offsets[-1] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def pieces_of(batch: pa.RecordBatch, column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """A batch as batches of whole rows with so many bytes of text, so that what is worked out for one stays small."""
    for part in slices(batch.column(batch.schema.get_field_index(column)), limit):
        yield batch.slice(part.lo, part.hi - part.lo)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def two_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, at_once: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """64 bits, never 0, and 64 other bits of each span; few spans are hashed at once."""
    keys, checks = np.empty(len(starts), np.uint64), np.empty(len(starts), np.uint64)
    for i in range(0, len(starts), at_once):
        a, b = starts[i : i + at_once], ends[i : i + at_once]
        keys[i : i + at_once] = np.maximum(hash_spans(buf, a, b), np.uint64(1))
        checks[i : i + at_once] = hash_spans(buf, a, b, SECOND)
    return keys, checks


class SpanTable:
    """Numbers of distinct byte strings, known by two independent hashes, 128 bits together; open addressing in arrays."""

    def __init__(self, room: int = 1 << 15):
        self.n, self.mask = 0, (1 << (2 * room - 1).bit_length()) - 1
        self.keys, self.checks, self.numbers = np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.uint64), np.zeros(self.mask + 1, np.int32)

    def find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """The number of each, or -1."""
        out, left, at = np.full(len(keys), -1, np.int32), np.arange(len(keys)), keys.astype(np.int64) & self.mask
        while len(left):
            there = self.keys[at]
            hit = (there == keys[left]) & (self.checks[at] == checks[left])
            out[left[hit]] = self.numbers[at[hit]]
            more = ~hit & (there != 0)
            left, at = left[more], (at[more] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, checks: np.ndarray) -> None:
        """Number new ones, in order; keys are distinct and not 0."""
        if 2 * (self.n + len(keys)) > self.mask:
            old = self.keys != 0
            kept = self.keys[old], self.checks[old], self.numbers[old]
            n = self.n
            self.__init__(2 * (self.n + len(keys)))
            self._put(*kept)
            self.n = n
        self._put(keys, checks, np.arange(self.n, self.n + len(keys), dtype=np.int32))
        self.n += len(keys)

    def _put(self, keys: np.ndarray, checks: np.ndarray, numbers: np.ndarray) -> None:
        left, at = np.arange(len(keys)), keys.astype(np.int64) & self.mask
        while len(left):
            free = np.flatnonzero(self.keys[at] == 0)
            slots, first = np.unique(at[free], return_index=True)
            won = left[free[first]]
            self.keys[slots], self.checks[slots], self.numbers[slots] = keys[won], checks[won], numbers[won]
            more = np.ones(len(left), bool)
            more[free[first]] = False
            left, at = left[more], (at[more] + 1) & self.mask


#: Longer spans, as passages in scripts without spaces are, hardly come again and aren't remembered. Bytes that what is remembered may take.
LONG_SPAN, MOST_BYTES = 48, 64 << 20


def unique_pairs(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each different pair of hashes is first, and the number of its pair for every one."""
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    new = np.ones(len(order), bool)
    new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    return order[new], which


class Distinct:
    """Works out each distinct span of the texts once in a Python worker; `learn` is called with the new ones.

    It forgets all when it holds more than `most` spans or MOST_BYTES, and spans over LONG_SPAN bytes with the next call, so
    its memory is bounded whatever the script.
    """

    def __init__(self, most: int):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.table, self.passing = SpanTable(), False

    def learn(self, words: list[str]) -> None:
        raise NotImplementedError

    def cut(self, n: int) -> None:
        """Forget what was learned but for the first n."""
        raise NotImplementedError

    def held(self) -> int:
        """Bytes of what was learned."""
        raise NotImplementedError

    def numbers(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each span; those of long spans hold until the next call."""
        if self.passing:
            self.cut(self.table.n)
            self.passing = False
        keys, checks = two_hashes(buf, starts, ends)
        long = ends - starts > LONG_SPAN
        found = self.table.find(keys, checks)
        new = np.flatnonzero((found < 0) & ~long)
        if len(new):
            first, which = unique_pairs(keys[new], checks[new])
            if self.table.n and (self.table.n + len(first) > self.most or self.held() > MOST_BYTES):
                self.clear()
                new = np.flatnonzero(~long)
                first, which = unique_pairs(keys[new], checks[new])
            at = new[first]
            found[new] = self.table.n + which
            self.table.add(keys[at], checks[at])
            self.learn(strings(buf, starts[at], ends[at]).to_pylist())
        if long.any():
            new = np.flatnonzero(long)
            first, which = unique_pairs(keys[new], checks[new])
            found[new] = self.table.n + which
            at = new[first]
            self.learn(strings(buf, starts[at], ends[at]).to_pylist())
            self.passing = True
        return found


class WordMemo(Distinct):
    """Integer lists of distinct spans, by ``encode(words)``."""

    def __init__(self, encode, most: int = 400_000):
        self.encode = encode
        super().__init__(most)

    def clear(self) -> None:
        super().clear()
        self.ids = np.zeros(1 << 16, np.int32)
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.count = self.used = 0

    def cut(self, n: int) -> None:
        self.count, self.used = n, int(self.starts[n - 1] + self.lengths[n - 1]) if n else 0

    def held(self) -> int:
        return 4 * self.used

    def learn(self, words: list[str]) -> None:
        rows = self.encode(words)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        first, last, total = self.count, self.count + len(rows), int(sizes.sum())
        for name, need in (("starts", last), ("lengths", last), ("ids", self.used + total)):
            if need > len(now := getattr(self, name)):
                setattr(self, name, np.concatenate([now, np.zeros(max(need - len(now), len(now) // 2), now.dtype)]))
        self.lengths[first:last], self.starts[first:last] = sizes, self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + total] = np.fromiter((x for row in rows for x in row), np.int32, total)
        self.count, self.used = last, self.used + total

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths, in ``self.ids``, of each span's list."""
        at = self.numbers(buf, starts, ends)
        return self.starts[at], self.lengths[at].astype(np.int64)


def strings(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Spans of a buffer as strings."""
    body = buf[ragged(starts, ends - starts)]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body)))


def word_array(part: Slice) -> pa.Array:
    """The words of a slice as strings."""
    return strings(part.buf, *part.spans)


def point_grams(points: np.ndarray, sizes: tuple[int, ...]) -> list[np.ndarray]:
    """For each of the ascending sizes, a number for every run of so many characters, in order: features, so mixed but lightly."""
    out, now, n = [], mix(points + FIRST), 1
    single = now
    for size in sizes:
        while n < size:
            now = now[: max(0, len(now) - 1)] * TURN + single[n:]
            n += 1
        out.append(now * TURN_2)
    return out
