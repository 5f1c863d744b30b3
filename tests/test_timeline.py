"""The densest window of a key against brute force, and what its plan must not have."""

import random

from pyspark.sql import functions as F

from tidepool.operators import timeline as W


def brute(rows, width):
    """Null stamps are counted by themselves and come first on ties."""
    out = {}
    for k, s in rows:
        n = [t for q, t in rows if q == k and (t is None if s is None else t is not None and s - width <= t <= s)]
        at = (-len(n), s is not None, s or 0)
        if k not in out or at < out[k][0]:
            out[k] = at, (len(n), None if s is None else min(n))
    return {k: v for k, (_, v) in out.items()}


def test_densest_window_equals_brute_force(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", "c", None]), r.randrange(-60, 60)) for _ in range(300)] + [("d", 20), ("d", 10), ("d", 0), ("e", None), ("e", 1), ("f", None), ("f", None), ("f", 7)]
    df = spark.createDataFrame(rows, "k string, stamp long")
    for width in (1, 10, 25, 500):
        assert {x.k: (x.n, x.origin) for x in W.densest_week(df, ["k"], width=width).collect()} == brute(rows, width)


def test_minute_bins_do_not_look_at_whole_windows(spark):
    """A frame over a range of stamps is gone through for each of its rows: the square of a full window."""
    df = spark.range(2_000_000).select(F.lit(1).alias("k"), (F.col("id") % 600_000).alias("stamp"), (F.col("id") * 7919 % 3_600_000).alias("progress"))
    out = W.minute_bins(df, ["k"], bin_ms=600_000)
    assert "RangeFrame" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = out.orderBy("minute").collect()
    assert [x.minute for x in got] == list(range(6)) and sum(x.n for x in got) == 2_000_000
    assert {(x.week_share, x.premiere_share) for x in got} == {(1.0, 1.0)}
