import json

from pyspark.sql import functions as F

from tidepool.operators import clusters as C
from tidepool.operators import filters as FL
from tidepool.operators import timeline as W
from tidepool.operators import views as V
from tidepool.operators import voice as VO
from tidepool.plans import catalogue
from tidepool.sources import comments as K
from tidepool.sources import pages as P


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_records_and_categories(spark, tmp_path):
    for n, track in enumerate(("a", "none")):
        (tmp_path / f"{n}.json").write_text(json.dumps({"id": n, "track": track}, indent=1))
    assert rows(P.read_records(spark, str(tmp_path), "none").select("id", "skip_reason")) == [(0, None), (1, "notice")]
    listed = spark.createDataFrame([(1, [5, 3]), (1, [3, 9]), (2, [1])], "id long, categories array<int>")
    assert rows(P.union_categories(listed)) == [(1, [3, 5, 9]), (2, [1])]
    label = P.first_category(F.col("categories"), {9: "nine", 3: "three"}, (1, "one"), "other")
    assert rows(listed.select(label)) == [("nine",), ("one",), ("three",)]
    p = spark.createDataFrame([("2026-02-01", [4], "x", None), ("2025-12-31", [4], "2026", None), ("", [4], "2026", None), ("2026-02-01", [48], "x", None), ("2020-01-01", [], "x", True), (None, None, "2026", None)], "date string, categories array<int>, title string, listed boolean")
    assert [r[0] for r in p.select(P.in_year(F.col("listed"), F.col("date"), F.col("categories"), F.col("title"), 2026, [48], [4])).collect()] == [True, False, True, True, True, False]
    page = spark.createDataFrame([(1, [("http://h/a.pdf", "t"), ("http://h/b", "t")], [("http://h/c.zip",), ("http://h/a.pdf",)])], "page_id long, links array<struct<href:string,text:string>>, media array<struct<url:string>>")
    assert rows(P.asset_links(page)) == [(1, 0, "http://h/a.pdf"), (1, 1, "http://h/c.zip")]
    assert page.select(P.page_markdown(F.lit("T"), F.lit("u"), F.lit("d"), F.lit("text"))).first()[0] == "# T\n\n- u\n- d\n\ntext"


def test_time_helpers(spark):
    c = spark.createDataFrame([("v", None, 5), ("v", 7, 1), ("w", 0, 9)], "video string, timeline_ms long, progress_ms long").withColumn("moment", W.moment())
    assert rows(c.select("video", "moment")) == [("v", 5), ("v", 7), ("w", 0)]
    parts = spark.createDataFrame([("w", 60), ("w", 30), ("v", 0)], "video string, duration int")
    assert rows(W.durations(c, parts)) == [("v", 8), ("w", 90_000)] and rows(W.durations(c, None)) == [("v", 8), ("w", 1)]
    s = spark.createDataFrame([("k", i, v) for i, v in enumerate((0.0, 3.0, 0.0))], "k string, i int, v double")
    assert [r.smooth for r in W.triangular(s, ["k"], "i", "v", 1).orderBy("i").collect()] == [1.0, 1.5, 1.0]
    d = spark.createDataFrame([("v", 100), ("v", None)], "video string, ctime long")
    assert {r.depth for r in W.send_depth(d, ["video"]).collect()} == {0.5}


def test_views(spark, tmp_path):
    assert rows(V.named_modes(spark.createDataFrame([(1,), (9,)], "mode int"), {1: "roll"})) == [(1, "roll"), (9, "other")]
    assert spark.range(1).select(V.per_10k(F.lit(3), F.lit(0)), V.per_10k(F.lit(3), F.lit(600))).first() == (0.0, 50.0)
    V.html_report(str(tmp_path / "r.html"), "<t>", {"a": spark.createDataFrame([("<b>", 1)], "name string, n int")})
    page = (tmp_path / "r.html").read_text()
    assert "&lt;b&gt;" in page and "<b>" not in page and "&lt;t&gt;" in page
    star = spark.range(1).select(C.star_place(F.array(F.lit(0.25), F.lit(0.75)), [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0)], 0.0, 0.0).alias("s")).first().s
    assert abs(star.x - 0.5) < 1e-9 and abs(star.y - 0.75**0.5) < 1e-9


def test_voices(spark):
    films = spark.createDataFrame([("p", "f1", ["x"]), ("p", "f2", []), ("q", "f3", ["y"])], "pool string, film string, matter array<string>")
    answers = spark.createDataFrame([("p", "f1")] * 9 + [("q", "f3")] * 8, "pool string, film string")
    assert rows(VO.coverage(films, answers)) == [("p", 2, 1, 9), ("q", 1, 1, 8)]
    assert rows(VO.unsettled(answers, spark.createDataFrame([("f3",)], "film string"))) == [("f1", 9)]
    hubs = spark.createDataFrame([("p", "b", 2), ("p", "a", 1)], "pool string, text string, place int")
    assert VO.direction(hubs, ["pool"]).first().sentence == 'Said again and again: "a", "b"'


def test_lists(spark):
    silver = spark.createDataFrame([("a", ["x"]), (" ", ["x"]), ("b", ["z"])], "text string, labels array<string>")
    assert rows(FL.silver_faults(silver, ["x"])) == [("blank text", 1), ("unknown label", 1)]
    assert rows(FL.silver_faults(silver.limit(1), ["x", "z"])) == [("fewer than two rows", 1)]
    d = spark.createDataFrame([("f", "u1", 0), ("f", "u2", 1)], "file string, url string, ord int")
    assert rows(K.last_by_name(d).select("file", "url")) == [("f", "u2")]
    keys = FL.title_keys(F.col("t"), F.lit("law"), ["预告"], ["绿茶"], ["law"], ["吗"], ["老师"])
    t = spark.createDataFrame([("绿茶吗",), ("绿茶预告",), ("这样好喝吗？老师",), ("无问",)], "t string")
    assert [r[0] for r in t.select(keys).collect()] == [["绿茶"], [], ["这样好喝"], []]


def test_reach_goes_over_a_whole_table(spark):
    d = "/root/testdata/sf0.001"
    links = {}
    for r in catalogue.table(spark, d, "lineitem").select("l_partkey", "l_orderkey").collect():
        links.setdefault(f"part/{r[0]}", set()).add(f"order/{r[1]}")
        links.setdefault(f"order/{r[1]}", set()).add(f"part/{r[0]}")
    depth, edge = {"part/1": 0}, {"part/1"}
    for n in range(1, 5):
        edge = {t for s in edge for t in links.get(s, ())} - depth.keys()
        depth |= dict.fromkeys(edge, n)
    got = {r.url: r.depth for r in catalogue.order_reach(spark, d).collect()}
    assert got == depth and len(got) > 100
