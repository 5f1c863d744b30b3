"""Every registered query that has SQL gives what DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# What an optional subpackage adds has tests of its own.
NAMES = sorted(n for n in entry.QUERIES)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(D):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    df = entry.QUERIES[name](spark, D)
    got = rows_of(df.columns, df.collect())
    if name not in entry.ORACLES:
        return
    cursor = db.execute(entry.ORACLES[name])
    want = rows_of([c[0] for c in cursor.description], cursor.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert all(all(a == b or isinstance(b, (int, float)) and abs(float(a) - float(b)) <= 1.1e-6 for a, b in zip(g, w, strict=True)) for g, w in zip(got[1], want[1], strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_summaries_hold_no_text(spark):
    """Aggregates that a report takes carry no raw text."""
    for name in ("corpus_totals", "code_lift", "pmi", "video_cards", "concentration", "pool_quality", "score_all"):
        assert not {"text", "content", "norm"} & set(entry.QUERIES[name](spark, D).columns)
