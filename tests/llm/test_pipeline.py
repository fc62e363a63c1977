import collections

import duckdb
import numpy as np
import pytest
from conftest import words
from test_ops import check_pieces, cut, near

import corpus_pipeline
from tidemark.llm import pii, quality
from tidemark.llm.queries import oracle_sql, queries


def test_pipeline_equals_plain_python(spark, sf):
    """Each stage against a plain version on what the stage before it kept; the classifier's verdicts are taken as they are."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = {r.doc_id for r in quality.judge(docs, model).where("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    rows = [(i, t) for i, t in rows if near_of(rows)[i][0] == i]
    texts = {i: " ".join(w) for i, _, _, w in cut(rows)}
    from tokenizers import Tokenizer

    from tidemark.llm.packing import tokenizer_path

    tokenizer, p = Tokenizer.from_file(tokenizer_path()), pii.Permutation(pii.QUERY_KEY)
    got = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in got} == set(texts)
    ids = {i: [*tokenizer.encode(pii.pseudonyms(t, p)[0], add_special_tokens=False).ids, 1] for i, t in texts.items()}
    check_pieces(got, ids, 2048)


_near = {}


def near_of(rows):
    key = len(rows)
    if key not in _near:
        _near[key] = near(rows)
    return _near[key]


def test_stages_keep_the_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert docs.where("n_chars != length(text)").count() == 0


def test_stages_keep_columns_of_any_name(spark, sf):
    """Names that operators use themselves, in other cases too; the values stay with their rows."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clashing = ["_doc", "_tag", "_runs", "_own", "_text", "N_words", "n_removed", "Kept", "good", "n_pii", "spans", "_id", "key", "node", "path", "a.b"]
    wide = docs.select("*", *[docs.doc_id.alias(c) for c in clashing])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns
        rows = out.select("doc_id", *[f"`{c}`" for c in clashing]).collect()
        assert rows and all(set(r) == {r[0]} for r in rows)


def test_stages_on_no_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_queries_equal_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries()[name](spark, sf).toPandas()
    want = con.execute(oracle_sql()[name]).df()[list(got.columns)]
    plain = lambda df: collections.Counter(tuple(None if x is None or x is np.nan or x != x else x for x in r) for r in df.astype(object).itertuples(index=False))
    assert plain(got) == plain(want) and sum(plain(got).values()) == len(want) and words("a b") == ["a", "b"]
