import numpy as np
from pyspark.sql import functions as F

from tidepool.operators import aggregates as A
from tidepool.operators import attach, sampling
from tidepool.sources import lists


def test_corpus_pass(spark):
    def small_only():
        def score(texts):
            if len(texts) > 3:
                raise MemoryError
            return np.array([[len(t) / 10, 0.5] for t in texts])

        return score

    texts = spark.createDataFrame([("a" * n, ["x"] if n % 2 else []) for n in range(1, 11)], "text string, truth array<string>")
    out = attach.decided(attach.scored(texts, small_only, ["x", "y"], batch=64, keep=("truth",)), ["x", "y"], [0.55, 0.99])
    assert {r.text: r.predicted for r in out.collect()} == {"a" * n: ["x"] if n >= 6 else [] for n in range(1, 11)}
    wrong, near = attach.folded(out, 2)
    assert [tuple(r) for r in wrong.collect()] == [("x", 3, 3)]
    assert [len(r.text) for r in near.orderBy("place").collect()] == [6, 4]
    assert {(r.code, r.place): len(r.text) for r in attach.by_code(out, ["x", "y"], [0.55, 0.99], 1).collect()}[("x", 1)] in (5, 6)


def test_halving_gives_up_at_one():
    def always(n):
        raise MemoryError

    try:
        attach.in_smaller_batches(always, 8)
    except MemoryError:
        return
    raise AssertionError


def test_locked_bindings(spark):
    counts = spark.createDataFrame([(u, "sym", "d", 3 + u % 2, 4, 5, 20) for u in range(10)], "unit long, name string, dim string, hits long, n long, base_hits long, bearing long")
    units = spark.range(10).selectExpr("id as unit", "id as place")
    r = sampling.bootstrap_bindings(counts, sampling.draws(units, "unit", 30, 10), "unit", spark.createDataFrame([("sym", "d")], "name string, dim string")).first()
    assert r.low <= 3.5 <= r.high and r.share_bound == 1.0


def test_paged_lists(spark):
    def fetch(n):
        return [(f"v{n}{i}", i, "t", 1, 100 - 10 * n, 0, 0, "a") for i in range(2)] if n <= 3 else []

    spark.dataSource.register(lists.paged_list(fetch, most=5))
    df = spark.read.format("paged_list").load()
    assert [r.bvid for r in df.orderBy("page", "ord").collect()] == ["v10", "v11", "v20", "v21", "v30", "v31"]


def test_small_aggregates(spark):
    s = spark.createDataFrame([(1, 3.0), (1, 1.0), (1, 2.0), (1, 9.0), (2, None), (3, 5.0), (3, 5.0)], "k int, v double")
    assert {r.k: r.value for r in A.nearest_ranks(s, ["k"], "v", 50).collect()} == {1: 3.0, 3: 5.0}
    pairs = A.letter_pairs(spark.createDataFrame([("g", "v", "aaB a"), ("g", "v", "ba"), ("g", "w", None), ("g", "w", "z")], "grp string, video string, text string"))
    assert sorted((r.gram, r.n) for r in pairs.collect()) == [("aa", 2), ("ba", 1)]
    cards = spark.createDataFrame([("v", 1, "c", 0, 0), ("w", 1, "c", 2, 4)], "video string, grp int, code string, hits long, n long")
    groups = spark.createDataFrame([(1, "c", 0.25)], "grp int, code string, rate double")
    assert {r.video: r.lift for r in A.card_lifts(cards, groups).collect()} == {"v": None, "w": 2.0}
