"""Positions, bins, windows and sequences along a video and along calendar time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEEK = 7 * 86400


def moment(timeline: str = "timeline_ms", progress: str = "progress_ms") -> Column:
    return F.coalesce(timeline, progress, F.lit(0))


def bin_of(at: Column, length: Column, bins: int) -> Column:
    """The bin of a position; the end belongs to the last one."""
    return F.least(F.lit(bins - 1), (at / length * bins).cast("int"))


def durations(comments: DataFrame, parts: DataFrame | None, at: str = "moment") -> DataFrame:
    """(video, duration): the parts' sum in ms if positive, else the last moment plus one. parts: video, duration (s)."""
    last = comments.groupBy("video").agg((F.max(at) + 1).alias("_last"))
    if parts is None:
        return last.withColumnRenamed("_last", "duration")
    sums = parts.groupBy("video").agg((F.sum("duration") * 1000).alias("_sum"))
    return last.join(sums, "video", "left").select("video", F.when(F.col("_sum") > 0, F.col("_sum")).otherwise(F.col("_last")).alias("duration"))


def percent_in_film(progress: Column, page: Column, parts: Column) -> Column:
    """A moment as a share of the film: parts before, plus progress, of all; below 1; null for a missing or negative one. parts: array<struct<page, duration (s)>>."""
    total = F.aggregate(parts, F.lit(0).cast("double"), lambda a, p: a + F.coalesce(p["duration"], F.lit(0)) * 1000)
    before = F.aggregate(F.filter(parts, lambda p: p["page"] < page), F.lit(0).cast("double"), lambda a, p: a + F.coalesce(p["duration"], F.lit(0)) * 1000)
    return F.when((progress >= 0) & (total > 0), F.least(before + progress, total - 1) / total)


def densified(counts: DataFrame, keys: list[str], bin_col: str, bins: int, n: str = "n") -> DataFrame:
    """counts with a row for each bin of each key; empty bins hold 0."""
    every = counts.select(*keys).distinct().withColumn(bin_col, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(counts, [*keys, bin_col], "left").fillna(0, [n])


def bin_dominants(dim_counts: DataFrame, keys: list[str], bin_col: str, bins: int) -> DataFrame:
    """(keys, bin, dim): the dominant dimension of each bin, null where none; the first in order wins. dim_counts: keys, bin, dim, ord, n."""
    best = dim_counts.filter("n > 0").groupBy(*keys, bin_col).agg(F.max_by("dim", F.struct(F.col("n"), -F.col("ord"))).alias("dim"))
    every = dim_counts.select(*keys).distinct().withColumn(bin_col, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(best, [*keys, bin_col], "left")


def transitions(dominants: DataFrame, keys: list[str], bin_col: str = "bin") -> DataFrame:
    """(a, b, n): steps between adjacent bins that both have a dominant dimension."""
    nxt = F.lead("dim").over(Window.partitionBy(*keys).orderBy(bin_col))
    return dominants.withColumn("b", nxt).filter("dim is not null and b is not null").groupBy(F.col("dim").alias("a"), "b").agg(F.count("*").alias("n"))


def stay_rates(steps: DataFrame, least: int = 30) -> DataFrame:
    """(a, total, stay): how often a dimension follows itself, where enough steps leave it."""
    return steps.groupBy("a").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).filter(F.col("total") >= least).select("a", "total", (F.col("same") / F.col("total")).alias("stay"))


def equal_weight_series(dim_counts: DataFrame, bin_sizes: DataFrame) -> DataFrame:
    """(dim, bin, share): each video's share of a dimension in a bin, averaged over the videos that have rows there.

    dim_counts: video, bin, dim, n; bin_sizes: video, bin, size. Bins without rows are left out, dimensions without hits count 0.
    """
    videos = bin_sizes.filter("size > 0").groupBy("bin").agg(F.count("*").alias("videos"))
    shares = dim_counts.join(bin_sizes, ["video", "bin"]).groupBy("dim", "bin").agg(F.sum(F.col("n") / F.col("size")).alias("sum"))
    return shares.join(videos, "bin").select("dim", "bin", (F.col("sum") / F.col("videos")).alias("share"))


def arcs(series: DataFrame, bins: int = 20) -> DataFrame:
    """(dim, first, last, delta): means of the first and the last quarter of bins; missing bins are 0."""
    q = bins // 4
    early = F.sum(F.when(F.col("bin") < q, F.col("share")).otherwise(0.0)) / q
    late = F.sum(F.when(F.col("bin") >= bins - q, F.col("share")).otherwise(0.0)) / q
    return series.groupBy("dim").agg(early.alias("first"), late.alias("last")).withColumn("delta", F.col("last") - F.col("first"))


def bursts(counts: DataFrame, bins: int = 10, total_least: int = 6, bin_least: int = 3, times: float = 3.0) -> DataFrame:
    """(code, n): bins that hold several times the mean of a video's code. counts: video, code, bin, n. The mean is over all bins, empty or not."""
    total = F.sum("n").over(Window.partitionBy("video", "code"))
    hot = counts.withColumn("total", total).filter((F.col("total") >= total_least) & (F.col("n") >= bin_least) & (F.col("n") >= times * F.col("total") / bins))
    return hot.groupBy("code").agg(F.count("*").alias("n"))


def _densest(counts: DataFrame, keys: list[str], stamp: str, width: int) -> DataFrame:
    """(keys, n, at): the greatest count in a window that ends at a row, and that row's stamp. counts: keys, stamp, _c (rows).

    Time is dealt into parts as long as the window, so a window begins in its row's part or in the one before. A stamp counts in its own
    part from its time on, and in the next part from the start until the window has left it; a running sum over a part is the window's
    count. The work grows with the stamps, however many a window holds, and the parts of one key are separate. Null stamps are a part.
    """
    at, c, part = F.col(stamp), F.col("_c"), F.floor(F.col(stamp) / width)
    step = lambda at, kind, d: F.struct(at.alias("_at"), F.lit(kind).alias("_kind"), d.alias("_d"))
    here = counts.select(*keys, part.alias("_part"), step(at, 0, c).alias("_s"))
    later = counts.filter(at.isNotNull()).select(*keys, (part + 1).alias("_part"), F.explode(F.array(step(F.lit(None).cast(counts.schema[stamp].dataType), -1, c), step(at + width, 1, -c))).alias("_s"))
    w = Window.partitionBy(*keys, "_part").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    ends = here.unionByName(later).select(*keys, "_part", "_s.*").withColumn("_n", F.sum("_d").over(w)).filter("_kind = 0")
    return ends.groupBy(*keys).agg(F.min_by(F.struct(F.col("_n").alias("n"), F.col("_at").alias("at")), F.struct(-F.col("_n"), F.col("_at"))).alias("b")).select(*keys, "b.n", "b.at")


def _week_of_counts(counts: DataFrame, keys: list[str], stamp: str, width: int) -> DataFrame:
    """densest_week() of counts: keys, stamp, _c (rows)."""
    part = F.floor(F.col("at") / width)
    best = _densest(counts, keys, stamp, width).withColumn("_part", F.explode(F.when(F.col("at").isNull(), F.array(part)).otherwise(F.array(part - 1, part))))
    inside = counts.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(stamp).alias("_s"), F.floor(F.col(stamp) / width).alias("_p"))
    same = (F.col("_part") == F.col("_p")) & F.col("_s").between(F.col("at") - width, F.col("at"))
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    return best.join(inside, same, "left").groupBy(*keys).agg(F.max("n").alias("n"), F.min("_s").alias("origin"))


def densest_week(rows: DataFrame, keys: list[str], stamp: str = "stamp", width: int = WEEK) -> DataFrame:
    """(keys, n, origin): the greatest count in a window that ends at a row, both ends included, and its first stamp; the earliest on ties."""
    return _week_of_counts(rows.groupBy(*keys, stamp).agg(F.count("*").alias("_c")), keys, stamp, width)


def premiere_stats(rows: DataFrame, keys: list[str], least: int = 30, width: int = WEEK) -> DataFrame:
    """Share of rows in the densest week, and how the order along the film and the order in time agree. rows: keys, progress, stamp.

    Adjacent rows by (progress, stamp): later ones sent earlier (inv_all), gaps over a week (gap7); inv_pre and adj_pre count
    neighbours that are both in the premiere. Pools under `least` rows are left out.
    """
    week = densest_week(rows, keys).select(*keys, "origin")
    order = Window.partitionBy(*keys).orderBy("progress", "stamp")
    x = rows.join(week, keys).withColumn("inside", F.col("stamp").between(F.col("origin"), F.col("origin") + width))
    x = x.withColumn("_p", F.lag("stamp").over(order)).withColumn("_i", F.lag("inside").over(order))
    both = F.col("inside") & F.coalesce("_i", F.lit(False))
    out = x.groupBy(*keys).agg(
        F.count("*").alias("usable"),
        F.count_if("inside").alias("premiere_n"),
        F.count_if(F.col("_p").isNotNull()).alias("adj_all"),
        F.count_if(F.col("stamp") < F.col("_p")).alias("inv_all"),
        F.count_if(F.abs(F.col("stamp") - F.col("_p")) > width).alias("gap7"),
        F.count_if(both).alias("adj_pre"),
        F.count_if(both & (F.col("stamp") < F.col("_p"))).alias("inv_pre"),
        ((F.first("origin") - F.min("stamp")) / 86400).alias("week_offset_days"),
        ((F.max("stamp") - F.min("stamp")) / 86400).alias("span_days"),
    )
    return out.filter(F.col("usable") >= least).withColumn("premiere_share", F.col("premiere_n") / F.col("usable"))


def minute_bins(rows: DataFrame, keys: list[str], least: int = 15, bin_ms: int = 60_000, width: int = WEEK) -> DataFrame:
    """(keys, minute, n, span_days, week_share, premiere_share) of the film's minutes with enough rows."""
    x = rows.groupBy(*keys, F.floor(F.col("progress") / bin_ms).alias("minute"), "stamp").agg(F.count("*").alias("_c"))
    origin = _week_of_counts(x.groupBy(*keys, "stamp").agg(F.sum("_c").alias("_c")), keys, "stamp", width).select(*keys, F.col("origin").alias("_o"))
    week = _densest(x, [*keys, "minute"], "stamp", width).select(*keys, "minute", F.col("n").alias("week_n"))
    hit = F.sum(F.when(F.col("stamp").between(F.col("_o"), F.col("_o") + width), F.col("_c")).otherwise(0))
    g = x.join(origin, keys).groupBy(*keys, "minute").agg(F.sum("_c").alias("n"), ((F.max("stamp") - F.min("stamp")) / 86400).alias("span_days"), hit.alias("hit")).filter(F.col("n") >= least)
    return g.join(week, [*keys, "minute"]).select(*keys, "minute", "n", "span_days", (F.col("week_n") / F.col("n")).alias("week_share"), (F.col("hit") / F.col("n")).alias("premiere_share"))


def crowded_spans(rows: DataFrame, keys: list[str], percent: str = "percent", bins: int = 50, share: float = 0.7) -> DataFrame:
    """(keys, start, end): maximal runs of bins whose smoothed count is near the peak."""
    counts = rows.groupBy(*keys, bin_of(F.col(percent), F.lit(1), bins).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy("bin")
    d = densified(counts, keys, "bin", bins).withColumn("smooth", (F.coalesce(F.lag("n").over(w), F.lit(0)) + F.col("n") + F.coalesce(F.lead("n").over(w), F.lit(0))) / 3)
    hot = d.withColumn("peak", F.max("smooth").over(Window.partitionBy(*keys))).filter((F.col("peak") > 0) & (F.col("smooth") >= F.col("peak") * share))
    islands = hot.withColumn("island", F.col("bin") - F.row_number().over(w))
    return islands.groupBy(*keys, "island").agg((F.min("bin") / bins).alias("start"), ((F.max("bin") + 1) / bins).alias("end")).drop("island")


def dense_windows(rows: DataFrame, keys: list[str], percent: str = "percent", bins: int = 10) -> DataFrame:
    """(keys, bin, n): bins with more rows than the upper median of all bins."""
    counts = rows.groupBy(*keys, bin_of(F.col(percent), F.lit(1), bins).alias("bin")).agg(F.count("*").alias("n"))
    d = densified(counts, keys, "bin", bins)
    middle = d.groupBy(*keys).agg(F.get(F.array_sort(F.collect_list("n")), F.lit(bins // 2)).alias("middle"))
    return d.join(middle, keys).filter(F.col("n") > F.col("middle")).select(*keys, "bin", "n")


def send_depth(rows: DataFrame, keys: list[str], stamp: str = "ctime") -> DataFrame:
    """rows with `depth` in [0, 1]: logarithm of the hours since the pool's first row, up to the 99th percentile by nearest rank; 0.5 where unknown."""
    from tidepool.operators.aggregates import nearest_ranks

    hours = rows.join(rows.groupBy(*keys).agg(F.min(stamp).alias("_first")), keys, "left").withColumn("_h", (F.col(stamp) - F.col("_first")) / 3600)
    cap = nearest_ranks(hours, keys, "_h", 99).withColumnRenamed("value", "_cap")
    depth = F.least(F.greatest(F.log1p("_h") / F.log1p("_cap"), F.lit(0.0)), F.lit(1.0))
    return hours.join(cap, keys, "left").withColumn("depth", F.when(F.col("_cap") > 0, F.coalesce(depth, F.lit(0.5))).otherwise(0.5)).drop("_first", "_h", "_cap")


def triangular(series: DataFrame, keys: list[str], place: str, value: str, radius: int = 7) -> DataFrame:
    """series with `smooth`: a triangular mean over neighbours within the radius."""
    w = Window.partitionBy(*keys).orderBy(place)
    parts = [(radius + 1 - abs(d), F.lag(value, d).over(w) if d >= 0 else F.lead(value, -d).over(w)) for d in range(-radius, radius + 1)]
    top = sum((F.coalesce(c * k, F.lit(0.0)) for k, c in parts), F.lit(0.0))
    bottom = sum((F.when(c.isNotNull(), k).otherwise(0) for k, c in parts), F.lit(0))
    return series.withColumn("smooth", top / bottom)


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each key, with their `place`; order must break all ties."""
    if not keys:
        rows = rows.orderBy(*order).limit(k)  # k rows are numbered in one task, not all
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
