"""Queries against their SQL on small tables of cases that the test tables lack or have at larger sizes only."""

import datetime

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry


def both(spark, folder, name, table, rows):
    """The rows of a query and of its SQL over one table, exactly."""
    path = f"{folder}/{table}.parquet"
    pq.write_table(pa.Table.from_pylist(rows), path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    df = entry.QUERIES[name](spark, str(folder))
    cursor = db.execute(entry.ORACLES[name])
    at = [[c[0] for c in cursor.description].index(c) for c in df.columns]
    return sorted(map(tuple, df.collect()), key=repr), sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=repr)


#: Of these prices, a six hundred thousandth is half-way between two numbers of six digits, or next to it.
ORDERS = [{"o_orderkey": k, "o_custkey": k, "o_orderstatus": "P", "o_totalprice": 300_000.3 + 0.6 * k} for k in range(60)]
ORDERS += [{"o_orderkey": 12388, "o_custkey": 641, "o_orderstatus": "P", "o_totalprice": 300412.5}]


def test_nearest_by_code_rounds_as_its_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "nearest_by_code", "orders", ORDERS)
    assert got == want and len(got) == 100


def test_corpus_margin_rounds_as_its_sql(spark, tmp_path):
    got, want = both(spark, tmp_path, "corpus_margin", "orders", ORDERS)
    assert got == want and len(got) == 61


def order(key, customer, status, price):
    return {"o_orderkey": key, "o_custkey": customer, "o_orderstatus": status, "o_totalprice": price}


#: Rows that break an order of nulls or a rule on keys, and prices whose rounded score is no six-digit number.
ODD_ORDERS = {
    "status": [order(k, k, [None, "P", "F", ""][k % 4], 300_000.0 + k) for k in range(20)],
    "scores": [order(k, None if k % 2 else k, "P", None if k % 2 else 300_000.0 + k) for k in range(300)],
    "keys": [order(None if k == 5 else k, 7, "P", 300_000.0) for k in range(20)],
    "copies": [order(k % 50, k, "P", 300_000.0 + 100 * k) for k in range(150)],
    "magnitudes": [order(k, None, "P", (1 + k / 7) * 10.0 ** (14 + k % 6)) for k in range(120)],
    "overflow": [order(k, None, "P", 1.7e308 - k * 1e307) for k in range(12)],
}


@pytest.mark.parametrize("rows", ODD_ORDERS.values(), ids=list(ODD_ORDERS))
def test_corpus_margin_takes_odd_orders_as_its_sql(spark, tmp_path, rows):
    got, want = both(spark, tmp_path, "corpus_margin", "orders", rows)
    assert got == want and got


def test_nearest_by_code_puts_nulls_last(spark, tmp_path):
    got, want = both(spark, tmp_path, "nearest_by_code", "orders", ODD_ORDERS["scores"])
    assert got == want and len(got) == 100



def test_clean_titles_resolve_what_their_sql_does(spark, tmp_path):
    titles = ["a&amp", "&amp;lt; &lt;&gt;&quot;&#39;x&nbsp;y&amp;", "&ampx; &lt &#39 &#039; &hellip; &nbsp", " &nbsp;a&am&amp;p;", "\n\t a 　\xa0", "&", "", "x² ½ é a_b‿c Ⅷ --", "&amp;amp;nbsp;"]
    pages = [{"page_id": n, "url": "https://h/a", "html": f"<title>{t}</title>"} for n, t in enumerate(titles)]
    pages += [{"page_id": 50, "url": "https://h/a", "html": "no title"}, {"page_id": 51, "url": None, "html": None}]
    got, want = both(spark, tmp_path, "clean_titles", "pages", pages)
    assert got == want
