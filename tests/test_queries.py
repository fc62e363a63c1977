import datetime
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark import queries

ROOT = Path(__file__).resolve().parents[1]
NAMES = sorted(queries.queries())


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, list):
        return [plain(y) for y in x]
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return round(x, 6) if isinstance(x, float) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in found))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    got = queries.queries()[name](spark, sf)
    want = duck.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1500


def test_rest_stands_without_the_subpackage(tmp_path):
    for f in ["__spark_entry__.py", *[str(p.relative_to(ROOT)) for p in ROOT.glob("tidemark/**/*.py") if "llm" not in p.parts]]:
        (tmp_path / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / f).write_bytes((ROOT / f).read_bytes())
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) == len(NAMES), out.stderr
