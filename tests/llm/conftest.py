import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


@pytest.fixture(scope="session")
def corpus():
    """Texts with copies, near copies, shared passages, empty and long ones, and text in other scripts."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [text(rng.randint(1, 120)) for _ in range(60)]
    passage = text(60)
    rows += [text(10) + "\n" + passage + "\t" + text(rng.randint(0, 9)) for _ in range(6)]
    base = text(150)
    for i in range(12):
        near = base.split(" ")
        near[(i * 11) % 150] = f"new{i}"
        rows.append(" ".join(near))
    rows += [base] * 5 + ["", None, " \n\t ", "one", "one two three", "ab " * 300, text(3000), "x" * 5000, "same line\n" * 30]
    return list(enumerate(rows))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string").repartition(3).cache()


@pytest.fixture
def odd(spark):
    """Null ids, repeated rows, one id with two texts, and columns with names that operators use."""
    rows = [(None, "a null id here", 1), (5, "twice the same", 2), (5, "twice the same", 2), (6, "one id", 3), (6, "two texts", 4), (7, None, 5), (8, "", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token int")
    for c in ("_doc", "_tag", "_runs", "n_words", "kept", "score", "ids", "n_pii", "spans", "key", "rule", "doc", "class_id", "rows", "label", "start", "number", "priority"):
        df = df.withColumn(c, df.token)
    return df


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
