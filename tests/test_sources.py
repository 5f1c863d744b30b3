import gzip
import io
import json
import zipfile

import pytest

from tidepool.operators import joins, timeline
from tidepool.sources import comments as K
from tidepool.sources import pages as P


def lines(*rows):
    return "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows).encode()


def test_tolerant_and_strict_lines(spark, tmp_path):
    (tmp_path / "v1.jsonl.gz").write_bytes(gzip.compress(lines({"id": 1, "content": "好", "progress_ms": 5}, "", "{broken", {"id": "x", "content": "typed", "ctime": 9})))
    (tmp_path / "v2.jsonl.gz").write_bytes(gzip.compress(b""))
    rows = K.read_comments(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.bvid, r.id, r.content, r.progress_ms, r.ctime) for r in rows] == [("v1", 1, "好", 5, None), ("v1", None, "typed", None, 9)]
    assert [tuple(r) for r in K.skipped_lines(spark, str(tmp_path)).collect()] == [("v1", 1)]
    with pytest.raises(Exception, match="broken line"):
        K.read_comments(spark, str(tmp_path), strict=True).collect()


def test_archives(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("f/a.meta.json", json.dumps({"title": "片", "parts": [{"page": 1, "duration": 10}, {"page": 2, "duration": 30}]}))
        z.writestr("f/a.jsonl.gz", gzip.compress(lines({"content": "x", "progress_ms": 5000, "page": 2}, "nope", {"content": "y"})))
        z.writestr("f/b.jsonl.gz", gzip.compress(b""))
    (tmp_path / "pool.zip").write_bytes(buffer.getvalue())
    archive = K.read_archive(spark, str(tmp_path), skip_bad=True)
    assert archive.filter("broken").count() == 1
    rows = K.archive_comments(archive)
    percent = rows.select("content", timeline.percent_in_film(rows.progress_ms, rows.page, rows.parts).alias("p")).collect()
    assert [tuple(r) for r in percent] == [("x", 15000 / 40000), ("y", None)]
    with pytest.raises(Exception):
        K.read_archive(spark, str(tmp_path)).collect()


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(number, body):
    return varint(number << 3 | 2) + varint(len(body)) + body


def element(ident, progress, text):
    return message(1, varint(8) + varint(ident) + varint(16) + varint(progress) + varint(24) + varint(1) + b"\x2d\0\0\0\0" + message(7, text.encode()) + varint(64) + varint(1_700_000_000))


def test_segments(spark):
    blob = element(99, 40000, "妙") + element(2**40, 5, "") + element(100, 40100, "好 a") + varint(5 << 3) + varint(300)
    rows = K.decode_segments(spark.createDataFrame([("s1", bytearray(blob)), ("s2", None)], "path string, content binary")).collect()
    assert [(r.path, r.ord, r.id, r.progress_ms, r.mode, r.content, r.ctime) for r in rows] == [("s1", 0, 99, 40000, 1, "妙", 1_700_000_000), ("s1", 1, 100, 40100, 1, "好 a", 1_700_000_000)]
    assert K.segment_count(message(4, varint(8) + varint(1) + varint(16) + varint(7))) == 7 and K.segment_count(b"") is None
    with pytest.raises(K.BrokenMessage):
        K.segment_comments(b"\x0a\xff")
    segments = spark.createDataFrame([("v", 1, 5, 100, "x"), ("v", 1, 5, 100, "x"), ("v", 2, 6, 50, "y"), ("v", 2, 4, None, "z")], "bvid string, cid long, id long, progress_ms long, content string")
    parts = spark.createDataFrame([("v", 1, 1, 10), ("v", 2, 2, 20)], "bvid string, page int, cid long, duration int")
    assert [(r.id, r.timeline_ms, r.ord) for r in K.assembled(segments, parts).orderBy("ord").collect()] == [(5, 100, 0), (4, 10000, 1), (6, 10050, 2)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "bvid string, n int, content string")
    K.write_comments(df, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").glob("bvid=*")) == ["bvid=a", "bvid=b"]
    with pytest.raises(ValueError, match="raw text"):
        K.write_summary(df, str(tmp_path / "s"))
    K.write_summary(df.drop("content"), str(tmp_path / "s"))
    listed = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "bvid string, list_ord int")
    assert [r.bvid for r in K.left_to_do(listed, df.filter("n = 1"), 0, 2).collect()] == ["c"]
    files = spark.createDataFrame([(bytearray(b"%PDF-1"), None), (bytearray(b"x" * 9000), None), (bytearray(b"x"), None), (bytearray(b"xy"), 2), (bytearray(b"PK.."), 9)], "d binary, e int")
    assert [r[0] for r in files.select(K.looks_complete(files.d, files.e)).collect()] == [True, True, False, True, False]


def test_pages(spark):
    html = "<p>a <b>b</b></p><script>x</script><a href='/7.html'>go <i>on</i></a><img data-src='i.png' alt='p'><div>&lt;c&gt;</div>"
    r = P.parse_pages(spark.createDataFrame([(1, "http://h/d/e", html), (2, None, None)], "page_id long, url string, html string")).orderBy("page_id").collect()
    assert r[0].text == "a b\ngo on\n<c>" and [tuple(x) for x in r[0].links] == [("http://h/7.html", "go on")] and [tuple(x) for x in r[0].images] == [("http://h/d/i.png", "p")]
    assert r[1].text == "" and r[1].links == []
    listing = spark.createDataFrame([('<a class=x href="http://h/12.html" t>One &amp; two</a><a href="/13.html"> b </a>',)], "html string")
    assert [tuple(x) for x in listing.select(P.listing(listing.html).alias("l")).first().l] == [("http://h/12.html", 12, "One & two"), ("/13.html", 13, "b")]


def test_matching_takes_later_ties(spark):
    rows = [("a", "x", 0.9, 0, 0), ("a", "y", 0.9, 0, 1), ("b", "y", 0.99, 1, 1), ("b", "x", 0.8, 1, 0), ("c", "x", 0.5, 2, 0)]
    df = spark.createDataFrame(rows, "l string, r string, s double, lp int, rp int")
    assert sorted((r.l, r.r) for r in joins.greedy_pairs(df, "l", "r", "s", "lp", "rp", 0.72).collect()) == [("a", "y"), ("b", "x")]
