"""Operator 9: language identification by segmentation-marginalised unigrams.

The pieces of a fixed public vocabulary have a probability in each language, estimated from
all training texts. The probability of a run of letters in a language is the sum over all its segmentations
into pieces, by the forward algorithm, whatever its length; a text's is the product over its runs. Only distinct
runs are worked out, and all of a batch's at once: a hash of every span looks up its piece. The sums are
scaled as they go on, so nothing is lost to underflow.

A piece's probability comes from how often its letters occur in the texts (all occurrences, not
their expected share of the segmentations, which would take further passes).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import widened
from .textops import MOST_BYTES, Distinct, Slice, WordMemo, as_text, mix, pieces_of, ragged, segment_sums, slices

#: Runs of letters are worked out together in groups of these widths; a longer one by itself.
WIDTHS = (6, 10, 14, 20, 32, 49)
_GROUP = np.searchsorted(WIDTHS, np.arange(WIDTHS[-1] + 1)).tolist()
#: Steps after which forward sums are scaled; places of a long run whose pieces are looked up at once.
SCALED, AT_ONCE = 8, 1 << 15
#: Added to each count; probability of a letter that is no piece.
SMOOTHING, UNKNOWN = 0.5, 1e-9
SLICE_BYTES = 2 << 20
#: Distinct runs that a worker remembers.
MEMO_WORDS = 600_000
FOLDS, HELD_OUT = 4, 2
_WORDS = re.compile(r"[^\W\d_]+")
_MAYBE = np.zeros(256, bool)
_MAYBE[65:91] = _MAYBE[97:123] = _MAYBE[128:] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def letter_runs(text: str) -> list[str]:
    """Runs of letters: characters of Unicode's category L."""
    out = []
    for run in _WORDS.findall(text):  # letters, and numbers that are no digits
        out += [run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split()
    return out


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """The letter pieces of a SentencePiece vocabulary, found by hash; ``\\u2581`` begins a word."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        texts = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.texts = sorted(t for t in texts if t and (t.removeprefix("▁") or "a").isalpha())
        self.longest = max(map(len, self.texts))
        keys = np.array([self.hash(np.array([[ord(c) for c in t]], np.uint64))[0] for t in self.texts], np.uint64)
        size = 1 << (len(keys) * 4).bit_length()
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.keys, self.ids = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        for i, key in enumerate(keys):
            at = int(key >> self.shift)
            while self.keys[at]:
                at = (at + 1) % size
            self.keys[at], self.ids[at] = key, i

    @staticmethod
    def hash(codes: np.ndarray) -> np.ndarray:
        h = np.ones(len(codes), np.uint64)
        for column in codes.T:
            h = mix(h * _BASE + column)
        return h

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of the piece with each hash, or -1."""
        out, at, left = np.full(len(keys), -1, np.int32), (keys >> self.shift).astype(np.int64), None
        while len(at):
            there = self.keys[at]
            hit = there == keys
            out[np.flatnonzero(hit) if left is None else left[hit]] = self.ids[at[hit]]
            more = np.flatnonzero(~hit & (there != 0))
            left, keys, at = more if left is None else left[more], keys[more], (at[more] + 1) % len(self.keys)
        return out

    def spans(self, codes: np.ndarray):
        """(start, end, piece of each word or -1) of all spans of padded words; none reaches into the padding."""
        n = codes.shape[1]
        for i in range(n):
            h = np.ones(len(codes), np.uint64)
            for j in range(i + 1, min(n, i + self.longest) + 1):
                h = mix(h * _BASE + codes[:, j - 1])
                yield i, j, self.find(h)

    def along(self, codes: np.ndarray):
        """(start, its pieces as (end, number)) at every place of one run, a stretch of places at a time; a character that is no piece is -1."""
        for lo in range(0, len(codes), AT_ONCE):
            h, ends = np.ones(min(AT_ONCE, len(codes) - lo), np.uint64), [[] for _ in range(min(AT_ONCE, len(codes) - lo))]
            for n in range(1, self.longest + 1):
                m = min(len(h), len(codes) - lo - n + 1)
                h = mix(h[:m] * _BASE + codes[lo + n - 1 : lo + n - 1 + m])
                found = self.find(h)
                for k in (np.arange(m) if n == 1 else np.flatnonzero(found >= 0)).tolist():
                    ends[k].append((lo + k + n, int(found[k])))
            yield from zip(range(lo, lo + len(ends)), ends, strict=True)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def by_length(words: list[str]):
    """The runs of letters of all words, with the mark of a word's beginning: (owners, lengths, code points).

    In a few groups of like length, padded with 0, and each long one by itself.
    """
    parts: list[tuple[list[int], list[str]]] = [([], []) for _ in WIDTHS]
    for i, w in enumerate(words):
        for r in letter_runs(w):
            r = "▁" + r
            if len(r) > WIDTHS[-1]:
                yield np.array([i]), np.array([len(r)]), np.frombuffer(r.encode("utf-32-le"), np.uint32).astype(np.uint64)[None]
            else:
                own = parts[_GROUP[len(r)]]
                own[0].append(i)
                own[1].append(r)
    for n, (owners, texts) in zip(WIDTHS, parts, strict=True):
        if texts:
            codes = np.frombuffer("".join([t.ljust(n, "\0") for t in texts]).encode("utf-32-le"), np.uint32).reshape(-1, n)
            yield np.array(owners), np.array([len(t) for t in texts]), np.ascontiguousarray(codes.T, np.uint64).T


def letters(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ASCII letters and of other characters than ASCII: the bytes, starts and ends."""
    return part.buf, *part.runs(_MAYBE[part.buf])


def occurrences(path: str):
    """An encoder of words for WordMemo: all pieces that occur in a word."""

    def encode(words: list[str]) -> list[list[int]]:
        vocabulary, out = pieces(path), [[] for _ in words]
        for owners, _, codes in by_length(words):
            if codes.shape[1] > WIDTHS[-1]:
                out[owners[0]] += [x for _, ends in vocabulary.along(codes[0]) for _, x in ends if x >= 0]
                continue
            for _, _, found in vocabulary.spans(codes):
                for k in np.flatnonzero(found >= 0).tolist():
                    out[owners[k]].append(int(found[k]))
        return out

    return encode


class Counts(WordMemo):
    """How often each distinct run occurs in each language, turned into counts of pieces before it is forgotten."""

    def __init__(self, path: str):
        self.width = len(pieces(path).texts)
        self.of: dict[str, np.ndarray] = {}
        self.times: dict[str, np.ndarray] = {}
        super().__init__(occurrences(path), MEMO_WORDS)

    def clear(self) -> None:
        self.flush()
        super().clear()

    def cut(self, n: int) -> None:
        self.flush()
        super().cut(n)

    def flush(self) -> None:
        for lang, times in self.times.items():
            n = self.lengths[: len(times)]
            ids = self.ids[ragged(self.starts[: len(times)], n.astype(np.int64))]
            self.of.setdefault(lang, np.zeros(self.width + 1))[: self.width] += np.bincount(ids, np.repeat(times, n), self.width)
        self.times = {}

    def tally(self, lang: str, numbers: np.ndarray) -> None:
        got = np.bincount(numbers, minlength=self.count)
        old = self.times.get(lang)
        if old is not None:
            got[: len(old)] += old
        self.times[lang] = got


def _count(path: str):
    """Occurrences of each piece in the texts of each language, of one task; the documents stand after the last piece."""

    def run(batches):
        counts = Counts(path)
        for batch in (rows for whole in batches for rows in pieces_of(whole)):
            langs = batch.column("lang").dictionary_encode()
            names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy(zero_copy_only=False)
            for part in slices(pc.utf8_lower(as_text(batch.column("text"))), SLICE_BYTES):
                spans = letters(part)
                numbers = counts.numbers(*spans)
                lang = np.repeat(codes[part.lo : part.hi], np.diff(np.searchsorted(spans[1], part.offsets)))
                for k in np.unique(codes[part.lo : part.hi]).tolist():
                    counts.tally(names[k], numbers[lang == k])
                    counts.of.setdefault(names[k], np.zeros(counts.width + 1))[-1] += int((codes[part.lo : part.hi] == k).sum())
        counts.flush()
        for name, x in counts.of.items():
            found = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(x[found])], ["lang", "piece", "n"])

    return run


@dataclass
class Model:
    path: str
    langs: list[str]
    probabilities: np.ndarray  # piece, language; the last row is for unknown letters
    prior: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        """Log-probability of each word by language, and the number of its runs of letters."""
        vocabulary, out = pieces(self.path), np.zeros((len(words), len(self.langs) + 1))
        for owners, sizes, codes in by_length(words):
            sums = self._along(vocabulary, codes[0])[None] if codes.shape[1] > WIDTHS[-1] else self._together(vocabulary, sizes, codes)
            np.add.at(out, owners, np.column_stack([sums, np.ones(len(codes))]))
        return out

    def _together(self, vocabulary: Pieces, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The log of the forward sum at the end of each of some padded runs."""
        n, reach = codes.shape[1], vocabulary.longest
        forward, scale, out = np.zeros((n + 1, len(codes), len(self.langs))), np.zeros((len(codes), len(self.langs))), np.zeros((len(codes), len(self.langs)))
        forward[0], at = 1, -1
        for i, j, found in vocabulary.spans(codes):
            if i != at:  # all arcs to place i are in
                at = i
                if i and i % SCALED == 0:
                    top = forward[i].copy()
                    scale += np.log(top)
                    forward[i : min(n, i + reach) + 1] /= top
            if j == i + 1:
                forward[j] += forward[i] * self.probabilities[np.where(found < 0, len(self.probabilities) - 1, found)]
                if (ends := np.flatnonzero(sizes == j)).size:
                    out[ends] = np.log(forward[j, ends]) + scale[ends]
            elif (hit := np.flatnonzero(found >= 0)).size:
                forward[j, hit] += forward[i, hit] * self.probabilities[found[hit]]
        return out

    def _along(self, vocabulary: Pieces, codes: np.ndarray) -> np.ndarray:
        """The same of one long run; only the sums that pieces may still reach are kept."""
        reach = vocabulary.longest
        forward, scale = np.zeros((reach + 1, len(self.langs))), np.zeros(len(self.langs))  # of place i, at i modulo reach + 1
        forward[0] = 1
        for i, ends in vocabulary.along(codes):
            now = forward[i % (reach + 1)].copy()
            if i % SCALED == 0:
                scale += np.log(now)
                forward /= now
                now = np.ones(len(self.langs))
            forward[i % (reach + 1)] = 0
            for j, piece in ends:
                forward[j % (reach + 1)] += now * self.probabilities[piece]
        return np.log(forward[len(codes) % (reach + 1)]) + scale


class Scores(Distinct):
    """A model's values of distinct runs."""

    def __init__(self, model: Model):
        self.model = model
        super().__init__(min(MEMO_WORDS, MOST_BYTES // (8 * (len(model.langs) + 1))))

    def clear(self) -> None:
        super().clear()
        self.rows, self.count = np.zeros((1 << 14, len(self.model.langs) + 1)), 0

    def cut(self, n: int) -> None:
        self.count = n

    def held(self) -> int:
        return self.rows[: self.count].nbytes

    def learn(self, words: list[str]) -> None:
        last = self.count + len(words)
        if last > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(last - len(self.rows), len(self.rows) // 2), self.rows.shape[1]))])
        for i in range(0, len(words), 20_000):
            self.rows[self.count + i : min(last, self.count + i + 20_000)] = self.model.words(words[i : i + 20_000])
        self.count = last

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        at = self.numbers(buf, starts, ends)
        return self.rows[at]


def fit_languages(docs: DataFrame, path: str | None = None) -> Model | None:
    """Piece probabilities of every language in docs (text, lang), from all rows with a lang.

    Tasks add up their own rows first, so a shuffle row is a language and a piece. The
    model has the vocabulary's size for each language: the languages must be few hundreds.
    None if there are no rows to learn from.
    """
    path = path or vocabulary_path()
    width = len(pieces(path).texts)
    rows = docs.where(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(_count(path), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(rows["lang"]))
    if not langs:
        return None
    counts = np.zeros((width + 1, len(langs)))
    counts[rows["piece"].to_numpy(), [langs.index(x) for x in rows["lang"]]] = rows["n"]
    p = counts[:width] + SMOOTHING
    p = np.vstack([p / p.sum(0), np.full(len(langs), UNKNOWN)])
    return Model(path, langs, p, np.log((counts[width] + 1) / (counts[width] + 1).sum()))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score, its probability among the learned languages.

    A text that is null or has no letters (category L) is `und` with score 0, as is every text
    if there is no model. Columns with those names are replaced; repeated rows are judged alike;
    of languages with equal probability the first in the alphabet is taken. Whole texts of any length count.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        memo = Scores(model) if model else None
        for batch in (rows for whole in batches for rows in pieces_of(whole)):
            texts = batch.column(batch.schema.get_field_index("text"))
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for part in slices(pc.utf8_lower(as_text(texts)), SLICE_BYTES) if model else ():
                spans = letters(part)
                if not len(spans[1]):
                    continue
                rows = memo(*spans)
                bounds = np.searchsorted(spans[1], part.offsets)
                sums = segment_sums(rows, bounds[:-1], bounds[1:])
                z = sums[:, :-1] + model.prior
                best = z.argmax(1)
                share = 1 / np.exp(np.minimum(z - z.max(1, keepdims=True), 0)).sum(1)
                has = sums[:, -1] > 0.5
                pred[part.lo : part.hi][has] = np.array(model.langs, object)[best[has]]
                score[part.lo : part.hi][has] = share[has]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs.schema, "lang_pred string, score double"))


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    model = fit_languages(docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
