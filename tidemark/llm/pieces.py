"""Operator 3: SentencePiece encoding and decoding by a streaming Viterbi search.

The search runs over the lattice of a vocabulary's pieces, one character after another. An
arc is worth its piece's score in a unigram model. A byte-pair model has no scores to add
up: there an arc is open if its piece may follow the one before it, that is, if the model's
merges leave the two of them apart, and closed otherwise; the open path is the model's own
segmentation, so ids equal the library's.

The search keeps a window of the last positions, as many as the longest piece has
characters: only these can begin a later arc. As soon as the best paths to all of them share
a boundary, what lies before it is committed and forgotten, so memory is bounded
whatever a text's length. No piece crosses the place between two characters that are
neighbours in no piece, as before a word, so all paths meet there; what lies between such
places is worked out once and remembered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import widened
from .textops import Slice, WordMemo, as_text, ragged, slices

MARK = "▁"
SLICE_BYTES, DECODED_IDS = 2 << 20, 500_000
#: Words, and pairs of pieces, that a worker remembers.
MEMO_WORDS, MEMO_PAIRS = 500_000, 300_000
_vocabularies: dict[str, Vocabulary] = {}  # noqa: F821  (annotations aren't evaluated)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """A model file's pieces, scores and ids of bytes."""

    def __init__(self, path: str, unigram: bool = False):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.unigram = unigram
        self.ids: dict[str, int] = {}
        self.bytes = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i)):
                self.ids[piece] = i
        self.texts = {i: p for p, i in self.ids.items()}
        self.scores = {i: model.get_score(i) for i in self.texts}
        self.longest = max(map(len, self.ids))
        #: A trie of the pieces from their last character backwards; "" leads to a piece's id.
        self.endings: dict = {}
        for p, i in self.ids.items():
            node = self.endings
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.floor = min(self.scores.values()) - 10.0
        #: Pairs of bytes that are neighbours in some piece, spaces standing for marks.
        self.inside = np.zeros((256, 256), bool)
        for p in self.ids:
            raw = p.replace(MARK, " ").encode()
            self.inside[list(raw[:-1]), list(raw[1:])] = True
        self._joined: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """A byte-pair model's segmentation: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, before: int, piece: int) -> bool:
        """Do the merges leave these two pieces apart and whole? before -1: is the piece whole by itself?"""
        key = (before + 1 << 32) | piece
        known = self._joined.get(key)
        if known is None:
            if len(self._joined) >= MEMO_PAIRS:
                self._joined.clear()
            texts = [self.texts[i] for i in (before, piece) if i >= 0]
            known = self._joined[key] = self.merged("".join(texts)) == texts
        return known

    def of_character(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()]


class Stream:
    """Encodes characters as they come; `push` and `end` return the ids that are settled."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # from the last committed boundary on
        self.back = [0]  # for each position, where the best path's last arc begins
        self.last = [-1]  # that arc's piece; -1 at the start and after a character that is no piece
        self.score = [0.0]

    def _extend(self) -> None:
        """Carry the search on to the end of the window's text."""
        v, text, back, last, score = self.v, self.text, self.back, self.last, self.score
        endings, longest, known, may_follow = v.endings, v.longest, v._joined.get, v.may_follow
        for n in range(len(back), len(text) + 1):
            start, arc, node, found = n - 1, -1, endings, []
            for i in range(n - 1, (n - longest if n > longest else 0) - 1, -1):
                node = node.get(text[i])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None:
                    found.append((i, piece))
            if v.unigram:
                best = None
                for i, piece in found:
                    if best is None or score[i] + v.scores[piece] > best:
                        best, start, arc = score[i] + v.scores[piece], i, piece
                score.append(score[n - 1] + v.floor if best is None else best)
            else:
                for i, piece in reversed(found):
                    before = last[i]
                    follows = known((before + 1 << 32) | piece)
                    if may_follow(before, piece) if follows is None else follows:
                        start, arc = i, piece
                        break
            back.append(start)
            last.append(arc)

    def _path(self, to: int) -> list[int]:
        arcs = []
        while to > 0:
            arcs.append((self.last[to], self.text[self.back[to] : to]))
            to = self.back[to]
        return [i for piece, text in reversed(arcs) for i in ([piece] if piece >= 0 else self.v.of_character(text))]

    def _boundary(self) -> int:
        """The last position that the best paths to all positions of the window share."""
        ends = set(range(max(0, len(self.text) - self.v.longest + 1), len(self.text) + 1))
        while len(ends) > 1:
            far = max(ends)
            ends.discard(far)
            ends.add(self.back[far])
        return ends.pop()

    def _commit(self, to: int) -> list[int]:
        out = self._path(to)
        self.text, self.back, self.last = self.text[to:], [0, *(b - to for b in self.back[to + 1 :])], self.last[to:]
        if self.v.unigram:
            self.score = [s - self.score[to] for s in self.score[to:]]
        return out

    def push(self, text: str) -> list[int]:
        out: list[int] = []
        step = 4 * self.v.longest
        for i in range(0, len(text), step):
            self.text += text[i : i + step]
            self._extend()
            if len(self.text) >= step and (to := self._boundary()):
                out += self._commit(to)
        return out

    def end(self) -> list[int]:
        out = self._path(len(self.text))
        self.__init__(self.v)
        return out


def vocabulary(path: str) -> Vocabulary:
    if path not in _vocabularies:
        _vocabularies[path] = Vocabulary(path)
    return _vocabularies[path]


def encode_text(v: Vocabulary, text: str) -> list[int]:
    """Ids of a whole text, with the mark that begins it."""
    if not text:
        return []
    stream = Stream(v)
    return stream.push(MARK + text.replace(" ", MARK)) + stream.end()


_memos: dict[str, WordMemo] = {}


def _memo(path: str) -> WordMemo:
    if path not in _memos:
        v = vocabulary(path)

        def encode(words: list[str]) -> list[list[int]]:
            stream, out = Stream(v), []
            for w in words:
                out.append(stream.push(w.replace(" ", MARK)) + stream.end())
            return out

        _memos[path] = WordMemo(encode, MEMO_WORDS)
    return _memos[path]


def words(part: Slice, v: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of a slice's texts between boundaries that no piece crosses: bytes, starts, ends, bounds by document.

    Such a boundary lies between two characters that are neighbours in no piece, as before
    the space that begins a word. A text that isn't empty gets a space before it.
    """
    sizes = np.diff(part.offsets)
    buf = np.insert(part.buf, part.offsets[:-1][sizes > 0], 0x20)
    offsets = part.offsets + np.concatenate([[0], np.cumsum(sizes > 0)])
    starts = np.zeros(len(buf), bool)
    starts[offsets[:-1][sizes > 0]] = True
    starts[1:] |= ~v.inside[buf[:-1], buf[1:]] & ((buf[1:] & 0xC0) != 0x80)
    at = np.flatnonzero(starts)
    return buf, at, np.append(at[1:], len(buf)), np.searchsorted(at, offsets)


def spaced(texts: pa.Array) -> pa.Array:
    """The texts with a space for each mark of their own: the model sees the two alike."""
    texts = as_text(texts)
    return pc.replace_substring(texts, MARK, " ") if pc.any(pc.match_substring(texts, MARK)).as_py() else texts


def _encoded(batches, path: str, kept: list[str], text: str):
    """Batches of the kept columns and ids, a slice of documents at a time."""
    v, memo = vocabulary(path), _memo(path)
    for batch in batches:
        for part in slices(spaced(batch.column(text)), SLICE_BYTES):
            rows = batch.slice(part.lo, part.hi - part.lo)
            *spans, bounds = words(part, v)
            starts, lengths = memo(*spans)
            flat, counts = memo.ids[ragged(starts, lengths)], part.per_doc(lengths, bounds)
            offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            ids = pa.ListArray.from_arrays(offsets, pa.array(flat), mask=rows.column(text).is_null() if rows.column(text).null_count else None)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), ids], [*kept, "ids"])


def _decoded(batches, path: str, kept: list[str]):
    """Batches of the kept columns and text, so many ids at a time."""
    v = vocabulary(path)
    table: dict[int, bytes] = {i: p.replace(MARK, " ").encode() for i, p in v.texts.items()} | {i: bytes([b]) for b, i in enumerate(v.bytes)}
    size = max(table) + 2
    lengths = np.zeros(size, np.int64)
    lengths[list(table)] = [len(x) for x in table.values()]
    starts = np.cumsum(lengths) - lengths
    body = np.frombuffer(b"".join(table[i] for i in sorted(table)), np.uint8)
    for batch in batches:
        sizes = np.diff(batch.column("ids").offsets.to_numpy())
        group = np.cumsum(sizes) // DECODED_IDS
        at = np.flatnonzero(np.append(True, group[1:] != group[:-1])).tolist() if len(group) else []
        for lo, hi in zip(at, [*at[1:], len(group)], strict=True):
            rows = batch.slice(lo, hi - lo)
            ids = rows.column("ids")
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            flat = np.where((flat >= 0) & (flat < size), flat, size - 1)
            counts = np.where(ids.is_valid().to_numpy(zero_copy_only=False), sizes[lo:hi], 0)
            out = body[ragged(starts[flat], lengths[flat])]
            ends = np.concatenate([[0], np.cumsum(lengths[flat])])[np.concatenate([[0], np.cumsum(counts)])]
            texts = [None if null else bytes(out[i:j]).decode("utf-8", "replace").removeprefix(" ") for null, i, j in zip(ids.is_null().to_pylist(), ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])


def _only(schema: StructType, kept: list[str]) -> StructType:
    return StructType([f for f in schema.fields if f.name in kept])


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with ids (array of int) instead of the text: those of the whole text.

    A null text has null ids, an empty one none. Repeated rows are encoded one by one; a
    column named ids, in any case of letters, is replaced. Texts of any length work. A text's own `▁` counts as a
    space, as in the library, and so is decoded as one.
    """
    path = path or vocabulary_path()
    kept = [c for c in docs.columns if c.lower() not in ("ids", text.lower())]
    return docs.select(*kept, text).mapInArrow(lambda batches: _encoded(batches, path, kept, text), widened(_only(docs.schema, kept), "ids array<int>"))


def decode(coded: DataFrame, path: str | None = None) -> DataFrame:
    """coded with text instead of ids: pieces and bytes in a row, marks as spaces, without the first one.

    Null ids give a null text. Bytes that aren't UTF-8 give U+FFFD; ids outside the
    vocabulary and control ids give nothing.
    """
    path = path or vocabulary_path()
    kept = [c for c in coded.columns if c.lower() not in ("ids", "text")]
    return coded.select(*kept, "ids").mapInArrow(lambda batches: _decoded(batches, path, kept), widened(_only(coded.schema, kept), "text string"))


def encode_and_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids, and text as the ids give it: both directions in one pass of the workers."""
    path = path or vocabulary_path()
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _decoded(_encoded(batches, path, ["doc_id"], "text"), path, ["doc_id", "ids"]), widened(_only(docs.schema, ["doc_id"]), "ids array<int>, text string"))


def op3_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Of every document its ids, their number, and the SHA-256 of the text decoded from them."""
    both = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return both.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).alias("n_ids"), "ids", F.sha2("text", 256).alias("decoded_sha256"))
