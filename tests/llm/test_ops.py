import collections
import datetime
import hashlib
import itertools
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import words
from pyspark.sql import functions as F

from tidemark.llm import jaccard, langid, neighbours, packing, pieces, pii, quality, substrings, textops, toxicity, urlrules
from tidemark.llm.components import components

# Helpers over bytes.


def test_words_and_hashes(corpus):
    texts = [t for _, t in corpus]
    for limit in (1, 200, 1 << 19):
        got, hashes = [], {}
        for part in textops.slices(pa.array(texts), limit):
            found = textops.word_array(part).to_pylist()
            assert part.word_offsets[-1] == len(found)
            got += [found[i:j] for i, j in zip(part.word_offsets[:-1], part.word_offsets[1:], strict=True)]
            for w, a, b in zip(found, part.words.tolist(), part.words_2.tolist(), strict=True):
                assert hashes.setdefault(w, (a, b)) == (a, b)
        assert got == [words(t) for t in texts]
        assert len(set(hashes.values())) == len(hashes)


def thue_morse(n, a="a", b="b"):
    """A string on which polynomial hashes modulo a power of two collide with its mirror image."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


MIRRORED = [thue_morse(n, *ab) for n in (64, 1024, 2048, 4096) for ab in ("ab", "ba", "xy", "yx")]


def test_hashes_of_mirrored_patterns():
    part = next(textops.slices(pa.array([" ".join(MIRRORED)])))
    assert len(set(part.words.tolist())) == len(set(part.words_2.tolist())) == len(MIRRORED)
    values = np.array([1, 2], np.uint64)
    for n in (32, 1024):
        bits = np.array([c == "b" for c in thue_morse(n)]).astype(int)
        assert textops.windows(values[bits], n)[0][0] != textops.windows(values[1 - bits], n)[0][0]
    memo = textops.WordMemo(lambda ws: [[MIRRORED.index(w)] for w in ws])
    starts, _ = memo(part.buf, *part.spans)
    assert memo.ids[starts].tolist() == list(range(len(MIRRORED)))


def test_windows_are_equal_where_their_values_are():
    values = np.random.default_rng(3).integers(0, 2, 4000).astype(np.uint64)
    for n, found in zip((1, 2, 5, 8, 35, 55), textops.windows(values, 1, 2, 5, 8, 35, 55), strict=True):
        plain = [tuple(values[i : i + n].tolist()) for i in range(len(values) - n + 1)]
        assert len(plain) == len(found) and len(set(plain)) == len(set(found.tolist())) == len(set(zip(plain, found.tolist(), strict=True)))
    assert [len(x) for x in textops.windows(values[:3], 2, 35, 55)] == [2, 0, 0]


def test_mirrored_patterns_in_operators(spark):
    """Words and lines of 64 to 4,096 letters, each in a text of its own among equal ones, against the plain versions."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    fill = " ".join(f"w{i}" for i in range(34))
    rows = [(i, f"{w} {fill} \n{w}\n{MIRRORED[i ^ 1]}") for i, w in enumerate(MIRRORED)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substrings.cut_repeats(df).collect()} == {i: gone for i, _, gone, _ in cut(rows)}
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_classes(df).collect()} == near(rows)
    for r in quality.judge(df, None).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == quality_counts(rows[r.doc_id][1])
    model = SentencePieceProcessor(model_file=pieces.vocabulary_path())
    assert {r.doc_id: r.ids for r in pieces.encode(df).collect()} == {i: model.encode(t) for i, t in rows}
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    check_pieces(packing.pack(df).collect(), {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}, 2048)


def test_span_table_and_memo():
    rng = np.random.default_rng(0)
    table, keys = textops.SpanTable(4), np.unique(rng.integers(1, 2**63, 3000).astype(np.uint64))
    checks = keys >> np.uint64(3)
    for i in range(0, len(keys), 500):
        table.add(keys[i : i + 500], checks[i : i + 500])
    assert table.find(keys, checks).tolist() == list(range(len(keys)))
    assert (table.find(keys, checks + np.uint64(1)) == -1).all()
    calls = []
    memo = textops.WordMemo(lambda ws: calls.append(len(ws)) or [[len(w)] * len(w) for w in ws], most=3)
    for text in (b"aa b ccc aa", b"dddd b", b"e aa"):
        part = next(textops.slices(pa.array([text.decode()])))
        starts, lengths = memo(part.buf, *part.spans)
        assert [memo.ids[s : s + n].tolist() for s, n in zip(starts, lengths, strict=True)] == [[len(w)] * len(w) for w in text.split()]
    assert calls == [3, 2, 2] or sum(calls) >= 6


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7)]
    root = {x: x for ab in links for x in ab}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    linked = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.root for r in components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1: neighbours.


def test_neighbours_recall_and_order(spark, sf):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = neighbours.op1_neighbours(spark, sf).collect()
    ids, v = np.array([i for i, _ in rows]), np.stack([x for _, x in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = u @ u[ids == q][0]
        best = sorted(((-x, i) for x, i in zip(s, ids, strict=True) if i != q))[:5]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == [1, 2, 3, 4, 5] and [-x[2] for x in mine] == sorted(-x[2] for x in mine)
        assert all(abs(x[2] - s[ids == x[1]][0]) < 1e-12 for x in mine)
        hits, total = hits + len({i for _, i in best} & {x[1] for x in mine}), total + 5
    assert hits / total >= 0.9


def crowded(n, d=16):
    """n vectors of which every third is a near copy of one, so that these have the same pivot order or nearly so."""
    rng = np.random.default_rng(12)
    v = rng.standard_normal((n, d))
    v[::3] = v[0] + 1e-6 * rng.standard_normal(v[::3].shape)
    return v


def test_neighbours_among_near_copies(spark):
    v = crowded(3000)
    df = spark.createDataFrame(list(enumerate(v.tolist())), "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in neighbours.nearest(df, F.col("vec_id") % 50 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 3000, 50):
        s = neighbours.cosines(v[q], v)
        s[q] = -2
        assert len(got[q]) == 5
        hits += (s[sorted(got[q])] >= np.sort(s)[-5]).sum()
    assert hits >= 0.95 * 5 * 60


def test_neighbours_odd_vectors(spark):
    good = [(i, [float(np.cos(i)), float(np.sin(i)), 1.0]) for i in range(1, 20)]
    same = [(100 + i, [3.0, 4.0, 0.0]) for i in range(30)]
    odd = [(200, None), (202, [0.0, 0.0, 0.0]), (204, [1.0, None, 0.0]), (206, [float("nan"), 1.0, 0.0]), (208, [float("inf"), 1.0, 0.0]), (None, [1.0, 0.0, 0.0]), (210, [1.0]), (212, [])]
    df = spark.createDataFrame(good + same + odd + good[:3], "vec_id long, embedding array<double>")
    got = neighbours.nearest(df, F.col("vec_id") % 2 == 0, k=5).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append((r.vec_id, r.score))
    assert set(by) == {i for i, _ in good + same if i % 2 == 0}
    for q in range(100, 130, 2):
        assert [i for i, _ in by[q]] == [i for i in range(100, 130) if i != q][:5] and all(s == 1.0 for _, s in by[q])
    for q in range(2, 20, 2):
        assert len({i for i, _ in by[q]}) == 5 and q not in {i for i, _ in by[q]}
    assert not {i for found in by.values() for i, _ in found} & {i for i, _ in odd}
    other = [(300 + i, [1.0, float(i)]) for i in range(4)] + [(300, [5.0, 1.0]), (300, [5.0, 1.0])]  # one more dimension, and an id with two vectors
    both = neighbours.nearest(spark.createDataFrame(good + other, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=9).collect()
    assert {r.query_id for r in both if r.query_id < 300} == set(range(2, 20, 2)) and all((r.query_id < 300) == (r.vec_id < 300) for r in both)
    found = {q: [r.vec_id for r in sorted(both, key=lambda r: r.rank) if r.query_id == q] for q in (300, 302)}
    assert found == {300: [301, 302, 303], 302: [303, 301, 300, 300]}
    few = spark.createDataFrame(good[:3], "vec_id long, embedding array<float>")
    assert neighbours.nearest(few, F.lit(True)).count() == 6
    assert neighbours.nearest(few.limit(0), F.lit(True)).count() == 0


# 2: URL filters.


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host) :])[0]


def test_url_rules(spark):
    urls = [
        None, "", "no scheme", "http://", "https://Example.COM/en/x", "https://www.example.com/en/1", "http://wwwexample.com/en/", "http://a.b.net/es/x?y#z", "http://net/fr/", "http://xnet/fr/", "HTTP://É.net/es/",
        "https://example.com", "https://example.com?x=/en/", "https://example.com/EN/", "ftp://u:p@example.com:80/en/", "https://ads-track.example.org/x", "https://free-bets.example.net/en", "https://x.org/adserver/1",
        "https://x.org/banner/a/ads/1", "https://x.org/banners/ads", "https://blog.x.org/en/1.html", "://example.com/en/", "a://b://example.com/en/", "https://x.org/a\nb/com/", "https://example.com/en/" + "x" * 9000,
    ]
    df = spark.createDataFrame([(i, u, "mine", "mine") for i, u in enumerate(urls + urls[4:8])], "page_id long, url string, host string, number string")
    got = {r.page_id: r for r in urlrules.filter_urls(df).collect()}
    assert len(got) == df.count() and set(next(iter(got.values())).asDict()) == {"page_id", "url", "number", "host", "path", "rule", "pattern", "verdict"}
    for i, u in enumerate(urls + urls[4:8]):
        host, path = url_parts(u)
        fits = [(len(t), t, v) for t, v in urlrules.HOST_RULES for h, _, p in [t.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        want = max(fits)[1:] if fits else (None, None)
        r = got[i]
        assert (r.host, r.path, r.rule) == (host, path, want[0]), u
        if not fits:
            hits = [(len(f), v) for f, v in urlrules.FILTERS if re.search(urlrules.filter_rule(f, v).pattern, host + path, re.S)]
            assert r.verdict == (max(hits, key=lambda x: x[0])[1] if hits else "allow"), u
        else:
            assert r.verdict == want[1]
    assert urlrules.filter_urls(df.limit(0)).count() == 0


def fits(pattern, text):
    """A filter pattern against a host and path, by trying every place, without regular expressions."""

    def here(p, at):
        if not p:
            return True
        if p[0] == "*":
            return any(here(p[1:], k) for k in range(at, len(text) + 1))
        if p[0] == "^":
            free = at < len(text) and not (text[at].isascii() and (text[at].isalnum() or text[at] in "_.%-"))
            return here(p[1:], at + 1) if free else at == len(text) and here(p[1:], at)
        return text[at : at + 1] == p[0] and here(p[1:], at + 1)

    host = text.partition("/")[0]
    starts = [0, *(i + 1 for i, c in enumerate(host) if c == ".")] if pattern.startswith("||") else range(len(text) + 1)
    return any(here(pattern.removeprefix("||"), k) for k in starts)


@pytest.mark.parametrize("most", [5, 100_000])
def test_many_filters_against_trying_each(spark, most, monkeypatch):
    """20,000 rules, some without a whole literal token, by broadcast and by shuffle; the verdict is that of the longest that fits."""
    monkeypatch.setattr(urlrules, "MOST_BROADCAST", most)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
    few = [("".join(rng.choice(["", "||"])) + rng.choice(["", "/", "^", "*"]) + rng.choice(["", "."]).join(word() for _ in range(rng.randint(1, 3))) + rng.choice(["", "^", "*", "/*"]), rng.choice(["block", "allow"])) for _ in range(60)]
    few = [f for f in dict(few).items() if urlrules.filter_rule(*f).tokens][: 60] + [("*", "allow"), ("a*b^", "block"), ("c", "block")]
    filters = few + [(f"||never{i}.example^", "block") for i in range(20_000 if most > 5 else 200)]
    urls = [f"http://{'.'.join(word() for _ in range(rng.randint(1, 3)))}{rng.choice(['', '/', '/' + word(), '/' + word() + '/' + word() + '.' + word()])}" for _ in range(120)] + ["http://x.never7.example/"]
    got = {r.url: (r.pattern, r.verdict) for r in urlrules.filter_urls(spark.createDataFrame([(u,) for u in urls], "url string"), host_rules=(), filters=tuple(filters)).collect()}
    for u in set(urls):
        hits = [(len(f), -i, f, v) for i, (f, v) in enumerate(filters) if (i < len(few) or "never" in u) and fits(f, u.removeprefix("http://"))]
        assert got[u] == (max(hits)[2:] if hits else (None, "allow")), u


def test_rules_are_found_by_whole_literal_tokens():
    assert urlrules.host_rule("net/es/", "block").tokens == ("net", "es")
    assert urlrules.host_rule("net/es", "block").tokens == ("net",)
    assert urlrules.filter_rule("||ads-track.*^", "block").tokens == ("ads", "track")
    assert urlrules.filter_rule("ads*x^", "block").tokens == ()


# 3: SentencePiece.


def test_ids_equal_the_library_and_decode_back(spark, docs, corpus):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.vocabulary_path())
    coded = pieces.encode(docs)
    got = {r.doc_id: r.ids for r in coded.collect()}
    assert got == {i: None if t is None else model.encode(t) for i, t in corpus}
    assert {r.doc_id: r.text for r in pieces.decode(coded).collect()} == dict(corpus)


def test_streaming_window_is_bounded_and_exact():
    from sentencepiece import SentencePieceProcessor

    model, v = SentencePieceProcessor(model_file=pieces.vocabulary_path()), pieces.vocabulary(pieces.vocabulary_path())
    rng = random.Random(2)
    for alphabet in ("abcdefgthein", "ab \n\té漢😀▁", "   x", "0123456789."):
        text = "".join(rng.choice(alphabet) for _ in range(4000)).replace("▁", "_")
        stream, out, most = pieces.Stream(v), [], 0
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        for i in range(0, len(marked), 7):
            out += stream.push(marked[i : i + 7])
            most = max(most, len(stream.text))
        assert out + stream.end() == model.encode(text)
        assert most <= 12 * v.longest


def test_unigram_scores_by_all_segmentations():
    v = pieces.Vocabulary(pieces.vocabulary_path(), unigram=True)
    rng, score = random.Random(5), lambda ids: sum(v.scores.get(i, v.floor) for i in ids)
    for _ in range(60):
        word = "".join(rng.choice("theinags") for _ in range(rng.randint(1, 9)))

        def best(at, word=word):
            return max((v.scores[v.ids[word[at:j]]] + best(j) for j in range(at + 1, len(word) + 1) if word[at:j] in v.ids), default=0.0 if at == len(word) else -1e18)

        stream = pieces.Stream(v)
        assert abs(score(stream.push(word) + stream.end()) - best(0)) < 1e-6


# 4: quality rules.


def quality_counts(t):
    w = words(t)
    lines = [x for x in (t or "").split("\n") if words(x)]
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>") if t else 0, len(lines) - len(set(lines)), len(covered)


def test_quality_counts(docs, corpus):
    got = {r.doc_id: r for r in quality.judge(docs, None).collect()}
    for i, t in corpus:
        n, *rest = quality_counts(t)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, *rest)
        assert r.base_failed == (n < 20 or 100 * rest[-1] > 30 * n) and r.kept == (not r.base_failed)


def test_quality_on_labelled_rows(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    model = quality.fit_quality(docs, labels.where("doc_id % 3 != 0"))
    rows = quality.judge(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) >= 0.95 and sum(r.kept for r in bad) / len(bad) <= 0.3
    assert quality.fit_quality(docs, labels.limit(0)) is None


# 5: substring dedup.


def cut(rows):
    seen = collections.Counter(tuple(w[i : i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    for i, t in rows:
        w = words(t)
        gone = {k for j in range(len(w) - 34) if seen[tuple(w[j : j + 35])] > 1 for k in range(j, j + 35)}
        yield i, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_substring_dedup(docs, corpus, block, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", block)
    got = {r.doc_id: r for r in substrings.cut_repeats(docs).collect()}
    assert len(got) == len(corpus)
    for i, n, gone, kept in cut(corpus):
        assert (got[i].n_words, got[i].n_removed, words(got[i].text)) == (n, gone, kept), i
    clean = {i for i, _, gone, _ in cut(corpus) if not gone}
    assert all(got[i].text == (t or "") for i, t in corpus if i in clean)


def test_every_difference_has_a_cover_position():
    cover, v = set(substrings.COVER), substrings.PERIOD
    assert all(any((i + d) % v in cover and (j + d) % v in cover for d in range(v)) for i in range(v) for j in range(v))
    assert substrings.SIZE == substrings.PERIOD + substrings.ANCHOR - 1


def test_a_block_sends_each_kind_once():
    keys, mores, docs, at = [5, 5, 5, 6, 7], [1, 1, 2, 1, 1], [10, 11, 10, 10, -3], [3, 100, 9, 70, 0]
    got = substrings.merged(np.array(keys, np.uint64), np.array(mores, np.uint64), np.array(docs), np.array(at)).to_pylist()
    what = lambda r: r["place"] & 3
    assert [(r["key"], r["more"], r["_doc"], r["place"] >> 2, what(r)) for r in got[:-1]] == [(5, 1, 10, 3, 1), (5, 2, 10, 9, 0), (6, 1, 10, 70, 0), (7, 1, -3, 0, 0)]
    assert (got[-1]["more"], got[-1]["_doc"], got[-1]["place"] >> 2, what(got[-1])) == (1 << 36, 11, 1, 2)


def test_a_block_sends_few_kinds_of_a_crowded_key():
    more = np.repeat(np.arange(100), 2)[:-1]  # each kind twice, the last once
    got = substrings.merged(np.full(199, 5, np.uint64), more.astype(np.uint64), np.arange(199), np.full(199, 70), 16).to_pylist()
    by = collections.defaultdict(list)
    for r in got:
        by[r["place"] & 3].append(r)
    assert [(r["key"], r["more"], r["_doc"]) for r in by[substrings.SEVERAL]] == [(5, 0, 0), (5, 1, 2)] and not by[substrings.ONCE]
    assert {r["_doc"] for r in by[substrings.ASKING]} == set(range(4, 199, 2)) and {r["_doc"] for r in by[substrings.SETTLED]} == set(range(198)) - {0, 2}
    assert all((r["more"], r["place"] >> 2) == (1 << 6, 1) for what in (substrings.ASKING, substrings.SETTLED) for r in by[what])
    few = substrings.merged(np.full(199, 5, np.uint64), more.astype(np.uint64), np.arange(199), np.full(199, 70), 100)
    assert len([r for r in few.to_pylist() if r["key"] == 5]) == 100


@pytest.mark.parametrize("kinds,block", [(2, 40), (2, 1 << 18), (16, 200), (16, 1 << 18)])
def test_a_phrase_amid_different_words(spark, kinds, block, monkeypatch):
    """A phrase of 20 to 34 words in most documents; some of them share the words beside it too."""
    monkeypatch.setattr(substrings, "KINDS", kinds)
    monkeypatch.setattr(substrings, "BLOCK", block)
    own = itertools.count()
    fresh = lambda n: [f"w{next(own)}" for _ in range(n)]
    phrase, before, after, rows = [f"p{i}" for i in range(34)], fresh(30), fresh(30), []
    for i in range(240):
        left, right = i % 9, i % 13
        near = before[30 - left :] if i % 5 == 0 else fresh(left)
        far = after[:right] if i % 3 == 0 else fresh(right)
        rows.append((i, " ".join(fresh(i % 7) + near + phrase[: 20 + i % 15] + far + fresh(12))))
    rows += [(240 + i, rows[7 * i][1]) for i in range(20)] + [(260, rows[17][1] + " " + rows[18][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, words(r.text)) for r in substrings.cut_repeats(df).collect()}
    want = {i: (n, gone, kept) for i, n, gone, kept in cut(rows)}
    assert got == want and len({gone for _, gone, _ in want.values()}) > 10


# 6: Jaccard join.


def shingles(t):
    w = words(t)
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near(rows):
    sets = {i: shingles(t) for i, t in rows}
    root, links = {i: i for i in sets}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), links[i]) for i in sets}


@pytest.mark.parametrize("block", [4, 384])
def test_jaccard_join(spark, docs, corpus, block, monkeypatch):
    """Small blocks deal a cluster over several groups; the result is the same."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_classes(docs).collect()}
    assert got == near(corpus)
    kept = {r.doc_id for r in jaccard.drop_near(spark, docs, "").collect()}
    assert kept == {i for i, (c, _) in near(corpus).items() if i == c}


def test_prefixes_are_shortened_until_the_recall():
    assert jaccard.shortened([(1.0, 10**9)], 8) == 8  # copies alone are found at full depth
    assert jaccard.shortened([], 8) < 8 and jaccard.shortened([(0.8, 1000)], 8) <= jaccard.shortened([(0.9, 1000)], 8) <= 8
    d = jaccard.shortened([(0.8, 10**6)], 8, recall=0.999)
    assert jaccard.met(0.8, d) >= 0.999 > jaccard.met(0.8, d + 1)


def edited(base, every, mark):
    """A copy of a list of words with one word changed in each stretch of so many."""
    return [f"{mark}{i}" if i % every == every // 2 else w for i, w in enumerate(base)]


def test_pairs_at_the_threshold_are_found(spark):
    """1,200 pairs of texts with one word changed: of 50 shingles each 45 are shared, or of 50 and 49, 44: 0.818 and 0.8."""
    rng, rows = random.Random(9), []
    for i in range(1200):
        base = [f"{rng.randrange(10**6)}" for _ in range(54)]
        other = base[:27] + ["x"] + base[28 : 54 - i % 2]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    want = {}
    for i in range(1200):
        a, b = shingles(rows[2 * i][1]), shingles(rows[2 * i + 1][1])
        n = int(len(a & b) >= 0.8 * len(a | b))
        want |= {2 * i: (2 * i, n), 2 * i + 1: (2 * i if n else 2 * i + 1, n)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(n for _, n in want.values()) >= 1200


@pytest.mark.parametrize("node", [4, 512])
def test_a_group_of_near_copies_and_a_crowd(spark, node, monkeypatch):
    """Nodes dealt into blocks: near copies of one text, copies that drift away from it, and texts that share a third of their words."""
    monkeypatch.setattr(jaccard, "NODE", node)
    rng = random.Random(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(60):
        near_ = list(base)
        near_[rng.randrange(120)] = f"n{i}"
        rows.append(" ".join(near_))
    drift = list(base)
    for i in range(12):
        drift[i * 9 + 4] = f"d{i}"
        rows.append(" ".join(drift))
    rows += [" ".join(base[:50] + [f"c{i}.{k}" for k in range(70)]) for i in range(60)]
    rows = list(enumerate(rows))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == near(rows)


def test_a_chain_of_weakly_similar_texts_is_not_verified_as_one(spark):
    """Neighbours share half of their shingles: none is linked, and nearly none is compared beyond its minima."""
    word = [f"w{i}" for i in range(60 * 400)]
    rows = [(i, " ".join(word[i * 20 : i * 20 + 60])) for i in range(400)]
    sketch = spark.createDataFrame([(i, bytearray(jaccard.path(s))) for (i, _), s in zip(rows, jaccard.shingle_sets(next(textops.slices(pa.array([t for _, t in rows]), 1 << 30))), strict=True)], "node long, path binary")
    comps = collections.Counter(r.comp for r in jaccard.clusters(sketch, 0.8).collect())  # of the classes that are to be compared
    assert sum(n * n for n in comps.values()) < 0.2 * len(rows)


def test_rows_of_one_id_and_null_ids_are_judged_by_their_texts(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    rows = [(5, text("a")), (6, text("a")), (6, text("b")), (6, text("b")), (None, text("c")), (None, text("c") + " end"), (None, text("d")), (7, text("d"))]
    df = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], "doc_id long, text string, path int, `_ID.x` int")
    got = sorted((r.doc_id or -1, r.class_id or -1, r.n_links) for r in jaccard.near_classes(df).collect())
    assert got == sorted([(5, 5, 1), (6, 5, 1), (6, 6, 1), (6, 6, 1), (-1, -1, 1), (-1, -1, 1), (-1, 7, 1), (7, 7, 1)])
    kept = jaccard.drop_near(spark, df, "")
    assert kept.columns == df.columns and sorted(r.text[0] for r in kept.collect()) == ["a", "b", "c", "d"]


# 7: packing.


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t in corpus}
    check_pieces(packing.pack(docs, capacity=256).collect(), ids, 256)
    digest = packing.digest(packing.pack(docs)).collect()
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in digest)


def check_pieces(rows, ids, capacity):
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {i: [x for _, part, _ in sorted(p) for x in part] for i, p in by.items()} == ids
    assert all(n == len(ids[i]) for i, p in by.items() for _, _, n in p)
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at == capacity or at & (at - 1) == 0


def test_packer_balances_and_fills():
    rng = random.Random(4)
    p, out, lengths = packing.Packer(100), [], {}
    for block in range(5):
        keys = [(block, i) for i in range(60)]
        sizes = [rng.choice([1, 3, 20, 60, 99, 100, 250]) for _ in keys]
        lengths |= dict(zip(keys, sizes, strict=True))
        out += p.block(sizes, keys)
    full = collections.Counter()
    for _, _, n, s, _ in out:
        full[s] += n
    assert set(full.values()) == {100}
    out += p.finish()
    got = collections.Counter()
    for k, _, n, _, _ in out:
        got[k] += n
    assert got == lengths and p.finish() == []


def plain_packing(blocks, cap):
    """Pieces by looking at every sequence of a block for each document."""
    out, next_, open_ = [], 0, None  # open_: cost, number, pieces
    for lengths, keys in blocks:
        rest = []
        for key, n in zip(keys, lengths, strict=True):
            for i in range(n // cap):
                out.append((key, i * cap, cap, next_))
                next_ += 1
            if n % cap:
                rest.append([n % cap, n // cap * cap, key])
        total = sum(r[0] for r in rest) + (sum(p[2] for p in open_[2]) if open_ else 0)
        sequences = [open_] if open_ else []
        while len(sequences) * cap < total:
            sequences.append([0.0, next_, []])
            next_ += 1
        limits = [cap] * len(sequences)
        if limits:
            limits[-1] = total - cap * (len(limits) - 1)
        room = lambda i: limits[i] - sum(p[2] for p in sequences[i][2])
        for n, start, key in sorted(rest, key=lambda r: -r[0]):
            while n:
                some = [i for i in range(len(sequences)) if room(i)]
                whole = [i for i in some if room(i) >= n]
                at = min(whole or some, key=lambda i: (sequences[i][0], i))
                take = min(n, room(at))
                sequences[at][2].append((key, start, take))
                sequences[at][0] += packing.cost(take)
                start, n = start + take, n - take
        open_ = None
        for i, (c, s, own) in enumerate(sequences):
            if sum(p[2] for p in own) < cap:
                open_ = sequences[i]
            else:
                out += [(k, a, n, s) for k, a, n in own]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_packer_looks_at_every_sequence(seed):
    rng = random.Random(seed)
    blocks = [([rng.choice([1, 2, 30, rng.randint(1, 400)]) for _ in range(150)], [(b, i) for i in range(150)]) for b in range(3)]
    packer = packing.Packer(128)
    got = [(k, a, n, s) for lengths, keys in blocks for k, a, n, s, _ in packer.block(lengths, keys)]
    assert sorted(got) == sorted(plain_packing(blocks, 128))


def test_special_texts_in_packing(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|> a", "A<|ENDOFTEXT|>B it's I'M don't", "a,'s ''s x'ré I’m …, ….", "É, é.É a\u00a0b\u2003c\x1cd 1a2b A1", "word.word,word!?'t", "\ufeff\u0301a \u0301", "ﬁ Ǆ İstanbul ΣΑΣ", "a" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    check_pieces(packing.pack(df).collect(), {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}, 2048)


# 8: personal data.


def test_pseudonyms_keep_format_and_links():
    p = pii.Permutation(b"key")
    text = "+1 (136) 555-7479, 4012888888881881; 4111 1111 1111 1111 and 233.254.104.120 was.91@mail6.example.com 2024-02-29 31.12.1999 123-45-6789 DE89 3704 0044 0532 0130 00"
    new, spans = pii.pseudonyms(text, p)
    assert [k for k, _, _ in spans] == ["phone", "card", "card", "ipv4", "email", "date", "date", "ssn", "iban"]
    assert all(text[s : s + n] not in new for _, s, n in spans)
    again, _ = pii.pseudonyms("x " + text, p)
    assert again == "x " + new and pii.pseudonyms(text, pii.Permutation(b"other"))[0] != new
    kinds = [k for k, _, _ in pii.pseudonyms(new, p)[1]]
    assert kinds == [k for k, _, _ in spans]
    cards = re.findall(r"[0-9]{16}|[0-9]{4}(?: [0-9]{4}){3}", new)
    assert all(pii.luhn(c.replace(" ", "")) for c in cards[:2])


@pytest.mark.parametrize("text", ["", "no numbers", "4111111111111112", "300.1.1.1", "1.2.3.4.5", "2023-02-29", "version 1.2.3", "000-12-3456", "DE88370400440532013000", "a@b", "token = \"b44e15e09fd311c3cf3163b66d5a9875b883d8ce\"", "0000000000000000", "12345 678", "1" * 5000])
def test_what_fails_its_check_stays(text):
    assert pii.pseudonyms(text, pii.Permutation(b"k")) == (text, [])


@pytest.mark.parametrize("before,after", [("", " 12/27"), ("", " 123"), ("", " 12 27 99"), ("", " 3rd"), ("1 ", ""), ("99 88 77 ", ""), ("2024-02-29 ", ""), ("7 ", " 12 2027"), ("", " 5500 0000 0000 0004")])
@pytest.mark.parametrize("card", ["4111 1111 1111 1111", "4111-1111-1111-1111", "3782 822463 10005", "4012888888881881"])
def test_cards_beside_other_numbers(card, before, after):
    p = pii.Permutation(b"k")
    new, spans = pii.pseudonyms(before + card + after, p)
    assert ("card", len(before), len(card)) in spans
    assert new[len(before) : len(before) + len(card)] == pii.pseudonyms(card, p)[0] != card


@pytest.mark.parametrize("before,after", [("", " EUR"), ("", " 12 27"), ("", " EUR 4000 NOW"), ("AB12 ", ""), ("IBAN ", " BIC"), ("", " and")])
@pytest.mark.parametrize("iban", ["ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", "DE89 3704 0044 0532 0130 00"])
def test_ibans_beside_other_words(iban, before, after):
    p = pii.Permutation(b"k")
    assert pii.pseudonyms(before + iban + after, p)[0] == before + pii.pseudonyms(iban, p)[0] + after != before + iban + after


def test_short_lists_of_numbers_stay():
    text = " ".join(map(str, range(1, 26)))
    assert pii.pseudonyms(text, pii.Permutation(b"k")) == (text, [])


def feistel(key, x, bound, name, allowed=lambda x: True):
    """The permutation, written out plainly."""
    key = hashlib.blake2b(key, digest_size=32).digest()
    half = max(1, (len(bin(bound - 1)) - 2 + 1) // 2)
    while True:
        left, right = divmod(x, 2**half)
        for i in range(8):
            size = -(-half // 8)
            f = hashlib.blake2b(bytes([i]) + right.to_bytes(size, "big"), digest_size=8 + size, key=key, person=name.encode()).digest()
            left, right = right, left ^ (int.from_bytes(f, "big") % 2**half)
        x = left * 2**half + right
        if x < bound and allowed(x):
            return x


def plain_pseudonym(kind, value, key):
    digits = "".join(c for c in value if c.isdigit())
    put = lambda new: "".join(next(new) if c.isdigit() else c for c in value)
    if kind == "ipv4":
        x = feistel(key, sum(int(o) << 8 * (3 - i) for i, o in enumerate(value.split("."))), 2**32, "ipv4")
        return ".".join(str(x >> 8 * (3 - i) & 255) for i in range(4))
    if kind == "ssn":
        ok = lambda x: x // 10**6 not in (0, 666) and x // 10**6 < 900 and x // 10**4 % 100 and x % 10**4
        return put(iter(f"{feistel(key, int(digits), 10**9, 'ssn9', ok):09d}"))
    if kind == "card":
        n = len(digits) - 1
        body = f"{feistel(key, int(digits[:-1]), 10**n, f'card{n + 1}', lambda x: len(set(f'{x:0{n}d}')) > 1 or set(f'{x:0{n}d}') == set() or x % (10**n // 9)):0{n}d}"
        weigh = lambda d: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        return put(iter(body + next(c for c in "0123456789" if weigh(body + c) % 10 == 0)))
    if kind == "date":
        first = datetime.date(1900, 1, 1).toordinal()
        size = datetime.date(2099, 12, 31).toordinal() - first + 1
        return (datetime.date.fromisoformat("1900-01-01") + datetime.timedelta(feistel(key, datetime.date.fromisoformat(value).toordinal() - first, size, "date"))).isoformat()
    local, _, domain = value.partition("@")
    x, bound = 0, 1
    radix = lambda c: 10 if c.isdigit() else 26 if c.isalpha() else 1
    for c in local:
        x, bound = x * radix(c) + (int(c) if c.isdigit() else ord(c.lower()) - 97 if c.isalpha() else 0), bound * radix(c)
    x, out = feistel(key, x, bound, f"mail{len(local)}"), ""
    for c in reversed(local):
        x, k = divmod(x, radix(c))
        out = (str(k) if c.isdigit() else (chr(65 + k) if c.isupper() else chr(97 + k)) if c.isalpha() else c) + out
    return f"{out}@{domain}"


def test_documents_against_plain_pseudonyms(spark):
    """Texts built from values of known kinds: each is replaced by its plain pseudonym, nothing else changes."""
    rng, key, rows, want = random.Random(6), b"secret", [], []

    def card():
        d = str(rng.choice([4, 51])) + "".join(str(rng.randrange(10)) for _ in range(14))
        d = d[:15]
        return d + next(c for c in "0123456789" if pii.luhn(d + c))

    make = {
        "ipv4": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)), "ssn": lambda: f"{rng.randint(1, 665):03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", "card": card,
        "date": lambda: (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_000))).isoformat(), "email": lambda: f"{rng.choice(['Ann', 'bob.x', 'c_d'])}{rng.randrange(99)}@mail{rng.randrange(9)}.example.org",
    }
    for i in range(120):
        text, new, spans = "", "", []
        for _ in range(rng.randrange(7)):
            filler = rng.choice(["words and ", "é漢 ", "version 1.2 ", "12 apples, ", "\n"])
            kind = rng.choice(list(make))
            value = make[kind]()
            spans.append((kind, len(text + filler), len(value)))
            text, new = text + filler + value + " ", new + filler + plain_pseudonym(kind, value, key) + " "
        rows.append((i, text))
        want.append((i, new, spans))
    got = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), key).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text, [(x.kind, x.start, x.length) for x in r.spans]) for r in got] == want


def test_dates_with_slashes_stay_apart():
    p, day = pii.Permutation(b"k"), datetime.date(1950, 1, 1)
    images = {}
    while day.year < 1990:
        for text in {f"{day.day:02d}/{day.month:02d}/{day.year}", f"{day.month:02d}/{day.day:02d}/{day.year}" if day.day > 12 else f"{day.day:02d}/{day.month:02d}/{day.year}"}:
            assert images.setdefault(pii.pseudonyms(text, p)[0], text) == text
        day += datetime.timedelta(3)


def test_permutation_is_one():
    p = pii.Permutation(b"k")
    for n in (2, 10, 97, 1000):
        assert sorted(p(i, n, "x") for i in range(n)) == list(range(n))
    even = lambda x: x % 2 == 0
    assert sorted(p(i, 50, "y", even) for i in range(0, 50, 2)) == list(range(0, 50, 2))


def test_pii_rows(spark, docs, corpus):
    got = {r.doc_id: (r.text, r.n_pii) for r in pii.pseudonymise(docs, b"k").collect()}
    assert got == {i: (t, 0) for i, t in corpus}
    hidden = pii.pseudonymise(spark.createDataFrame([(1, "é 10.0.0.1 x")], "doc_id long, text string"), b"k").first()
    assert hidden.n_pii == 1 and hidden.spans[0].asDict() == {"kind": "ipv4", "start": 2, "length": 8}


# 9: language.


def test_word_probability_sums_all_segmentations():
    path = langid.vocabulary_path()
    vocabulary = langid.pieces(path)
    rng = np.random.default_rng(3)
    model = langid.Model(path, ["a", "b"], np.vstack([rng.random((len(vocabulary.texts), 2)) * 1e-3, [1e-9, 1e-9]]), np.zeros(2))
    number = {t: i for i, t in enumerate(vocabulary.texts)}

    def total(w, k):
        if not w:
            return 1.0
        parts = [model.probabilities[number[w[:j]], k] * total(w[j:], k) for j in range(1, len(w) + 1) if w[:j] in number]
        if w[0] not in number:
            parts.append(1e-9 * total(w[1:], k))
        return sum(parts)

    for w in ["the", "thinst", "über", "漢é", "a1b"]:
        want = [sum(np.log(total("▁" + r, k)) for r in langid.letter_runs(w)) for k in (0, 1)]
        assert np.allclose(model.words([w])[0, :2], want)


def test_long_runs_of_letters_are_summed_whole():
    """Against logarithms of plain forward sums over all pieces, with no scaling: across any length, and behind unknown letters."""
    path = langid.vocabulary_path()
    vocabulary, rng = langid.pieces(path), np.random.default_rng(8)
    model = langid.Model(path, ["a", "b"], np.vstack([rng.random((len(vocabulary.texts), 2)) * 1e-3, [1e-9, 1e-9]]), np.zeros(2))
    number = {t: i for i, t in enumerate(vocabulary.texts)}
    longest = max(number, key=len)
    assert len(longest) > 12
    for run in ["the" * 15, "the" * 16, "the" * 17 + longest.strip("▁"), "漢" * 40 + "the", "ꙮ" * 400 + "the", longest.strip("▁") * 40, "international" * 300]:
        text = "▁" + run
        forward = np.full((len(text) + 1, 2), -np.inf)
        forward[0] = 0
        for j in range(1, len(text) + 1):
            arcs = [forward[i] + np.log(model.probabilities[number[text[i:j]]]) for i in range(max(0, j - len(longest)), j) if text[i:j] in number]
            if text[j - 1] not in number:
                arcs.append(forward[j - 1] + np.log(1e-9))
            forward[j] = np.logaddexp.reduce(arcs)
        got = model.words([run])[0]
        assert np.allclose(got[:2], forward[-1]) and got[2] == 1


def test_letters_are_those_of_category_l():
    assert langid.letter_runs("a1b_c² ½Ⅷx 漢字。é\u0301z") == ["a", "b", "c", "x", "漢字", "é", "z"]


def test_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = langid.op9_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and {r.doc_id for r in held} == {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    model = langid.fit_languages(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (6, "²"), (7, "½ 12"), (4, "the " * 9999), (5, "x" * 9999)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert all(got[i] == ("und", 0.0) for i in (1, 2, 3, 6, 7)) and got[4][0] == "en" and got[5][0] in model.langs
    assert langid.predict(odd, langid.fit_languages(docs.limit(0))).where("lang_pred != 'und'").count() == 0


# 10: toxicity.


def test_toxicity(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    rows = toxicity.op10_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id", "left").collect()
    held = [r for r in rows if r.held_out and r.toxic is not None]
    toxic, clean = [r for r in held if r.toxic == 1], [r for r in held if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) >= 0.6 and sum(r.predicted for r in clean) / len(clean) <= 0.1
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_scores_against_plain_sums():
    """A model of chosen features, over characters of several bytes, against loops over every n-gram."""
    rng = np.random.default_rng(2)
    mask = 2**64 - 1

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def grams(text):
        chars = [mixed(int.from_bytes((" " if c in " \t\n\v\f\r" else c).encode(), "little") + int(textops.FIRST) & mask) for c in text.lower()]
        for n in toxicity.GRAMS:
            for i in range(len(chars) - n + 1):
                h = chars[i]
                for x in chars[i + 1 : i + n]:
                    h = (h * int(textops.TURN) + x) & mask
                yield (h * int(textops.TURN_2) * int(toxicity.SPREAD) & mask) >> 64 - toxicity.BITS

    texts = ["You fool", "", None, "漢字かな交じり文 é", "a\tb\nC D" * 30, "ab", "😀😀😀😀 x"]
    weights = np.where(rng.random(1 << toxicity.BITS) < 0.5, rng.standard_normal(1 << toxicity.BITS), 0).astype(np.float32)
    got = toxicity.Model(weights, 0.25, 0.1, -0.2)(pa.array(texts))
    for t, x in zip(texts, got, strict=True):
        z = 0.25 + sum(float(weights[b]) for b in set(grams(t or "")))
        assert abs(x - 1 / (1 + np.exp(-(0.1 * z - 0.2)))) < 1e-9
    batch = pa.RecordBatch.from_pydict({"text": texts, "label": [1.0, 0.0, 1.0, 0.0, 1.0, 1.0, 1.0]})
    counts = {(r["bucket"]): (r["clean"], r["toxic"]) for b in toxicity._emit_counts([batch]) for r in b.to_pylist()}
    want = collections.defaultdict(lambda: [0, 0])
    for t, y in zip(texts, batch.column("label").to_pylist(), strict=True):
        for b in set(grams(t or "")):
            want[b][int(y)] += 1
    assert counts == {b: tuple(x) for b, x in want.items()}


def test_toxicity_without_labels(docs, spark):
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert model is None and {(r.score, r.predicted) for r in toxicity.score(docs, model).collect()} == {(0.0, 0)}


# Odd tables, for all.

OPERATORS = {
    "quality": lambda d: quality.judge(d, None),
    "substrings": substrings.cut_repeats,
    "jaccard": jaccard.near_classes,
    "drop_near": lambda d: jaccard.drop_near(None, d, ""),
    "packing": packing.pack,
    "pieces": lambda d: pieces.decode(pieces.encode(d)),
    "pii": lambda d: pii.pseudonymise(d, b"k"),
    "language": lambda d: langid.predict(d, None),
    "toxicity": lambda d: toxicity.score(d, None),
    "urls": lambda d: urlrules.filter_urls(d, url="text"),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(name, odd, empty):
    got = OPERATORS[name](odd).collect()
    assert len(got) >= odd.count() if name == "packing" else len(got) == (6 if name == "drop_near" else odd.count())
    assert OPERATORS[name](empty).collect() == []
    if name == "jaccard":
        by = collections.defaultdict(set)
        for r in got:
            by[r.doc_id].add((r.class_id, r.n_links))
        assert by[None] == {(None, 0)} and by[5] == {(5, 1)} and by[7] == {(7, 0)}


def test_texts_longer_than_slices_and_blocks(spark):
    """Texts of 2 to 5 million bytes: with and without spaces, twice, and with one word changed; against the plain versions."""
    rng = random.Random(11)
    word = [f"{rng.choice('abcdé漢')}{i % 9973}" for i in range(400_000)]
    long = " ".join(word)
    changed = list(word)
    changed[200_000] = "changed"
    rows = [(1, long), (2, long), (3, " ".join(changed)), (4, "x" * 3_000_000), (5, " ".join(word[:2000])), (6, "\n".join(["same line"] * 250_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert len(long.encode()) > 2 << 20
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    check_pieces(packing.pack(df).collect(), {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows if i != 4} | {4: [*tokenizer.encode(rows[3][1], add_special_tokens=False).ids, 1]}, 2048)
    got = {r.doc_id: r for r in quality.judge(df, None).drop("text").collect()}
    assert (got[1].n_words, got[4].n_words, got[6].n_dup_lines, got[6].n_repeat_words) == (400_000, 1, 249_999, 500_000)
    assert {r.doc_id: (r.class_id, r.n_links) for r in jaccard.near_classes(df).collect()} == {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (4, 0), 5: (5, 0), 6: (6, 0)}
    assert {r.doc_id: r.n_removed for r in substrings.cut_repeats(df).drop("text").collect()} == {1: 400_000, 2: 400_000, 3: 399_999, 4: 0, 5: 2000, 6: 500_000}
    hidden = pii.pseudonymise(df.where("doc_id = 1").selectExpr("doc_id", "concat(text, ' 10.0.0.1') as text"), b"k").first()
    assert hidden.n_pii >= 1 and hidden.spans[-1].start == len(long) + 1
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    assert toxicity.score(df, toxicity.Model(weights, 0.0, 1.0, 0.0)).where("score != 0.5").count() == 0
    langs = langid.fit_languages(spark.createDataFrame([("en", "the same line and words"), ("zh", "漢字")], "lang string, text string"))
    assert {r.doc_id: r.lang_pred for r in langid.predict(df.where("doc_id in (4, 6)"), langs).collect()}[6] == "en"
    assert urlrules.filter_urls(spark.createDataFrame([(1, "http://net/es/" + "x/" * 1_500_000)], "page_id long, url string")).first().rule == "net/es/"
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=pieces.vocabulary_path())
    assert {r.doc_id: r.ids for r in pieces.encode(df.where("doc_id in (3, 5)")).collect()} == {i: model.encode(t) for i, t in rows if i in (3, 5)}


def test_fitted_models_on_odd_rows(spark, odd, empty, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    good, toxic, langs = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels), langid.fit_languages(docs)
    for run in (lambda d: quality.judge(d, good), lambda d: toxicity.score(d, toxic), lambda d: langid.predict(d, langs)):
        assert run(odd).count() == odd.count() and run(empty).collect() == []
    named = odd.select("doc_id", "text", *[odd.token.alias(x) for x in ("Kept", "N_WORDS", "_own", "_text")])
    assert quality.judge(named, good).select("kept").count() == odd.count()


def test_samples_are_bounded_in_rows(spark):
    from tidemark.llm import linear

    docs = spark.createDataFrame([(1, "a copy")] * 500 + [(1, "another"), (2, None), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1)], "doc_id long, quality int")
    assert sorted((r.doc_id, r.text, r.label) for r in linear.labelled(docs, labels, "quality", 9).collect()) == [(1, "a copy", 1.0), (2, None, 0.0), (3, "c", 1.0)]
    assert linear.labelled(docs, labels, "quality", 2).count() == 2


def test_samples_are_bounded(spark, docs):
    from tidemark.llm import linear

    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (3, None), (4, 9)], "doc_id long, quality int")
    assert linear.labelled(docs, labels, "quality", 10).count() == 10


def test_queries_are_named():
    from tidemark.llm.queries import oracle_sql, queries

    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries()) == list(range(1, 14))
    assert set(oracle_sql()) < set(queries()) and json.dumps(oracle_sql())
