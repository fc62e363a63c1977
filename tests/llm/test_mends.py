"""Values that don't depend on neighbours, memory by script, marks in texts, and recall of the index."""

import random
import resource

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, linear, neighbours, packing, pieces, pii, quality, textops, toxicity

# Sums by document.


def test_sums_of_a_segment_are_its_own():
    rng = np.random.default_rng(1)
    own = rng.standard_normal(1000)
    alone = textops.segment_sums(own, np.array([0]), np.array([1000]))[0]
    for _ in range(20):
        before, after = rng.integers(0, 50, 2)
        values = np.concatenate([1e9 * rng.standard_normal(before), own, rng.standard_normal(after)])
        lo, hi = np.array([0, before, before, before + 1000]), np.array([before, before, before + 1000, len(values)])
        assert textops.segment_sums(values, lo, hi)[2] == alone and textops.segment_sums(values, lo, hi)[1] == 0
    table = rng.standard_normal((30, 3))
    assert np.allclose(textops.segment_sums(table, np.array([0, 10, 10, 30]), np.array([10, 10, 30, 30])), [table[:10].sum(0), [0] * 3, table[10:].sum(0), [0] * 3])


def test_copies_of_a_text_have_one_score_in_any_layout(spark, sf):
    """300 copies amid other texts, and all documents, in several layouts."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang"), spark.read.parquet(f"{sf}/labels.parquet")
    text = docs.where("n_chars > 500" if "n_chars" in docs.columns else "length(text) > 500").orderBy("doc_id").first()["text"]
    copies = docs.union(spark.range(10**6, 10**6 + 300).select("id", F.lit(text).alias("text"), F.lit("en").alias("lang")))
    language, good, toxic = langid.fit_languages(docs), quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    seen = []
    for n in (1, 2, 7):
        rows = copies.orderBy(F.xxhash64("doc_id", F.lit(n))).repartition(n) if n > 1 else copies.coalesce(1)
        a = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(rows, language).collect()}
        b = {r.doc_id: r.good for r in quality.judge(rows, good).collect()}
        c = {r.doc_id: r.score for r in toxicity.score(rows, toxic).collect()}
        assert all(len({x[i] for i in range(10**6, 10**6 + 300)}) == 1 for x in (a, b, c))
        seen.append((a, b, c))
    assert seen[0] == seen[1] == seen[2]


def test_sparse_rows_in_blocks(monkeypatch):
    rng = np.random.default_rng(2)
    ids = [np.sort(rng.permutation(300)[: rng.integers(0, 80)]).astype(np.uint16) for _ in range(40)]
    scale, dense = rng.standard_normal(300), np.zeros((40, 300))
    for row, i in zip(dense, ids, strict=True):
        row[i] = scale[i]
    w, g = rng.standard_normal(300), rng.standard_normal(40)
    for block in (1, 100, 1 << 20):
        monkeypatch.setattr(linear.Rows, "BLOCK", block)
        rows = linear.Rows(ids, scale)
        assert len(rows) == 40 and np.allclose(rows.dot(w), dense @ w) and np.allclose(rows.back(g), g @ dense)


# What workers remember.


def test_pairs_are_told_apart_by_both_hashes():
    keys, checks = np.array([5, 5, 7, 5, 7], np.uint64), np.array([1, 2, 1, 1, 1], np.uint64)
    first, which = textops.unique_pairs(keys, checks)
    assert sorted(first.tolist()) == [0, 1, 2] and which[0] == which[3] != which[1] and which[2] == which[4]


def test_equal_first_hashes_are_kept_apart(monkeypatch):
    hashed = textops.two_hashes
    monkeypatch.setattr(textops, "two_hashes", lambda *a: (np.full(len(a[1]), 9, np.uint64), hashed(*a)[1]))
    memo = textops.WordMemo(lambda ws: [[ord(w[0])] for w in ws])
    for text in ("ab cd ef ab", "cd gh ab"):
        part = next(textops.slices(pa.array([text])))
        at, _ = memo(part.buf, *part.spans)
        assert memo.ids[at].tolist() == [ord(w[0]) for w in text.split()]


def passages(n, length, seed):
    rng = random.Random(seed)
    return ["".join(chr(rng.randint(0x4E00, 0x4FFF)) for _ in range(length)) for _ in range(n)]


def test_long_spans_are_worked_out_and_not_remembered():
    calls = []
    memo = textops.WordMemo(lambda ws: (calls.append(len(ws)), [[len(w), ord(w[0])] for w in ws])[1])
    long = passages(50, 40, 1)
    for _ in range(3):
        part = next(textops.slices(pa.array([" ".join(["short", *long, "words", *long])])))
        at, n = memo(part.buf, *part.spans)
        assert [memo.ids[i : i + k].tolist() for i, k in zip(at, n, strict=True)] == [[len(w), ord(w[0])] for w in ["short", *long, "words", *long]]
    assert calls == [2, 50, 50, 50] and memo.table.n == 2


def test_memory_is_bounded_in_scripts_without_spaces():
    """Of ops 3, 7 and 9: what is remembered of passages stays small."""
    langs = langid.Model(langid.vocabulary_path(), ["en", "zh"], np.full((len(langid.pieces(langid.vocabulary_path()).texts) + 1, 2), 1e-4), np.zeros(2))
    counts, scores, memo = langid.Counts(langid.vocabulary_path()), langid.Scores(langs), pieces._memo(pieces.vocabulary_path())
    peak = []
    for seed in range(6):
        part = next(textops.slices(pa.array(passages(1500, 300, seed)), 2 << 20))
        spans = langid.letters(part)
        counts.tally("zh", counts.numbers(*spans))
        assert len(scores(*spans)) == len(spans[1])
        *spans, _ = pieces.words(part, pieces.vocabulary(pieces.vocabulary_path()))
        memo(*spans)
        peak.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024)
    assert counts.table.n == scores.table.n == 0 and memo.held() < 1 << 20
    assert peak[-1] - peak[1] < 100
    counts.flush()
    assert counts.of["zh"].sum() > 0


# Marks in texts.

MARKED = ["the▁end of▁it", "▁▁", "▁", "▁ a", "a▁", "  ▁▁  b", "x▁y▁", "▁the", "a\n▁b"]


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=pieces.vocabulary_path())


def test_marks_in_texts_are_encoded_as_the_library_does(spark, library):
    rng = random.Random(5)
    letters = sorted({c for p in list(pieces.vocabulary(pieces.vocabulary_path()).ids)[:4000] for c in p} | {"▁", " ", "\n"})
    texts = MARKED + ["".join(rng.choice(letters + ["▁", " "] * 20) for _ in range(rng.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.ids for r in pieces.encode(df).collect()}
    assert got == {**{i: library.encode(t) for i, t in enumerate(texts)}, -1: None, -2: []}
    decoded = {r.doc_id: r.text for r in pieces.encode_and_decode(df).collect()}
    assert all(decoded[i] == t.replace("▁", " ") for i, t in enumerate(texts)) and decoded[-1] is None and decoded[-2] == ""


# Recall of the permutation index.


def recall(v, n_queries=50, k=5):
    """Of the true k nearest, over blocks as the operator deals them; and the share of cosines that were worked out."""
    rng = np.random.default_rng(3)
    pivots = neighbours.unit(v[rng.permutation(len(v))[: neighbours.PIVOTS]])
    order, asked = neighbours.orders(v, pivots, neighbours.ORDER), rng.permutation(len(v))[:n_queries]
    table = lambda i: pa.table({"vec_id": pa.array(i), "v": pa.array(list(v[i])), "p": pa.array(list(order[i]))})
    found = {int(q): [] for q in asked}
    for lo in range(0, len(v), neighbours.BLOCK):
        got = neighbours.search_block(table(asked), table(np.arange(lo, min(len(v), lo + neighbours.BLOCK))), len(pivots), k)
        for q, i, s in zip(*[c.to_pylist() for c in got.columns], strict=True):
            found[q].append((-s, i))
    hits = 0
    for q in asked:
        s = neighbours.cosines(v[q], v)
        s[q] = -2
        hits += sum(-x >= np.sort(s)[-k] - 1e-12 for x, _ in sorted(found[int(q)])[:k])
    return hits / (k * n_queries)


@pytest.mark.parametrize("noise", [None, 0.05, 0.3, 1e-6])
def test_recall_of_the_index(noise, monkeypatch):
    """10,240 vectors of 64 dimensions, a third of them near copies of one; well under half of all cosines are worked out."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((10_240, 64))
    if noise:
        v[::3] = v[0] + noise * rng.standard_normal(v[::3].shape)
    work, cosines = [], neighbours.cosines
    monkeypatch.setattr(neighbours, "cosines", lambda q, x: (work.append(len(x)), cosines(q, x))[1])
    got = recall(v)
    assert got >= 0.9
    exact = 50 * 10_240
    assert sum(work) - exact < (0.4 if noise != 1e-6 else 0.6) * exact


# Phone numbers.


@pytest.mark.parametrize(
    "forms, code",
    [
        (("+44 20 7946 0958", "+442079460958", "+44-20-7946-0958", "+4420 7946 0958", "+44 2079 460958"), "44"),
        (("+1 212 555 0123", "+12125550123", "+1 (212) 555-0123"), "1"),
        (("+353 1 234 5678", "+35312345678", "+353 12 345 678"), "353"),
        (("+7 495 123 4567", "+74951234567"), "7"),
    ],
)
def test_a_number_has_one_pseudonym_however_it_is_grouped(forms, code):
    """Where the form is one that is found; the country stays."""
    p, images = pii.Permutation(b"k"), {}
    for form in forms:
        new, spans = pii.pseudonyms(f"call {form}, now", p)
        if not spans:
            assert form == "+353 1 234 5678"  # a group of one digit
            continue
        assert [k for k, _, _ in spans] == ["phone"] and new.startswith(f"call +{code}") and len(new) == len(f"call {form}, now")
        images[form] = "".join(c for c in new if c.isdigit())
    assert len(set(images.values())) == 1 and images[forms[1]] != "".join(c for c in forms[1] if c.isdigit())


def test_countries_and_numbers_stay_apart():
    p, seen = pii.Permutation(b"k"), {}
    for code, own in (("44", "2079460958"), ("49", "2079460958"), ("1", "2125550123"), ("353", "212555012"), ("7", "4951234567")):
        for i in range(50):
            new, _ = pii.pseudonyms(f"+{code}{int(own) + i}", p)
            assert new.startswith(f"+{code}") and seen.setdefault(new, (code, i)) == (code, i)
    assert [pii.calling_code(d) for d in ("12125550123", "74951234567", "442079460958", "35312345678", "21212345678", "8801712345678", "0123456789")] == [1, 1, 2, 3, 3, 3, 3]
