"""Counts, rates, lifts, bindings and scores over coded comments. Ratios with a zero denominator are 0 unless said otherwise.

A coded table has a row a comment: video, grp, codes array<string>, dims array<string>, and what a function names besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def totals(coded: DataFrame, laugh: Column) -> DataFrame:
    """Comments, coded, with several codes, without, laughter, and the rate of coded ones: one row."""
    n = F.size("codes")
    t = coded.agg(F.count("*").alias("comments"), F.count_if(n > 0).alias("coded"), F.count_if(n > 1).alias("multi"), F.count_if(n == 0).alias("unlabeled"), F.count_if(laugh).alias("laugh"))
    return t.withColumn("coded_rate", ratio(F.col("coded"), F.col("comments")))


def counts_by(coded: DataFrame, column: str, name: str, names: DataFrame | None = None, keys: list[str] = ()) -> DataFrame:
    """(keys, name, n) of an array column; zero-filled over `names` where given (and no keys)."""
    n = coded.select(*keys, F.explode(column).alias(name)).groupBy(*keys, name).agg(F.count("*").alias("n"))
    return n if names is None else names.join(n, name, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def group_buckets(videos: DataFrame, coded: DataFrame) -> DataFrame:
    """(grp, videos, empty, comments, coded): videos count even when empty. videos: video, grp."""
    own = coded.groupBy("video").agg(F.count("*").alias("comments"), F.count_if(F.size("codes") > 0).alias("coded"))
    joined = videos.join(own, "video", "left").fillna(0, ["comments", "coded"])
    return joined.groupBy("grp").agg(F.count("*").alias("videos"), F.count_if(F.col("comments") == 0).alias("empty"), F.sum("comments").alias("comments"), F.sum("coded").alias("coded"))


def lifts(coded: DataFrame, column: str, name: str) -> DataFrame:
    """(grp, name, n, rate, lift): the rate within the group over the rate among all; lift 0 where that is 0."""
    by = counts_by(coded, column, name, keys=["grp"])
    size = coded.groupBy("grp").agg(F.count("*").alias("of_group"))
    base = by.groupBy(name).agg(F.sum("n").alias("of_name")).crossJoin(F.broadcast(size.agg(F.sum("of_group").alias("of_all"))))
    rate = ratio(F.col("n"), F.col("of_group"))
    return by.join(size, "grp").join(base, name).select("grp", name, "n", rate.alias("rate"), ratio(rate, F.col("of_name") / F.col("of_all")).alias("lift"))


def card_lifts(cards: DataFrame, groups: DataFrame) -> DataFrame:
    """Rate of a video's card over its group's; null for an empty pool or a zero group rate. cards: video, grp, code, hits, n; groups: grp, code, rate."""
    r = groups.select("grp", "code", F.col("rate").alias("group_rate"))
    lift = F.when((F.col("n") > 0) & (F.col("group_rate") > 0), F.col("hits") / F.col("n") / F.col("group_rate"))
    return cards.join(r, ["grp", "code"], "left").withColumn("lift", lift)


def cooccurrence(coded: DataFrame, column: str = "codes") -> DataFrame:
    """(a, b, n): comments with both codes, each unordered pair in both directions, no diagonal."""
    c = F.col(column)
    pairs = F.filter(F.flatten(F.transform(c, lambda x: F.transform(c, lambda y: F.struct(x.alias("a"), y.alias("b"))))), lambda p: p["a"] != p["b"])
    return coded.filter(F.size(c) > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def pmi(coded: DataFrame, column: str = "codes") -> DataFrame:
    """(a, b, n, pmi): natural log of p(ab) / (p(a) p(b)) over comments; pairs that never meet are absent (0)."""
    single = counts_by(coded, column, "code")
    total = coded.agg(F.count("*").alias("total"))
    joined = cooccurrence(coded, column).join(single.select(F.col("code").alias("a"), F.col("n").alias("na")), "a").join(single.select(F.col("code").alias("b"), F.col("n").alias("nb")), "b").crossJoin(F.broadcast(total))
    return joined.select("a", "b", "n", F.log(F.col("n") * F.col("total") / (F.col("na") * F.col("nb"))).alias("pmi"))


def mode_counts(coded: DataFrame, mode: str = "mode") -> DataFrame:
    """(mode, n, coded); a null mode is left out."""
    return coded.filter(F.col(mode).isNotNull()).groupBy(mode).agg(F.count("*").alias("n"), F.count_if(F.size("codes") > 0).alias("coded"))


def hour_of(epoch: Column, offset_hours: int = 8) -> Column:
    return F.pmod(F.floor((epoch + offset_hours * 3600) / 3600), F.lit(24)).cast("int")


def hour_profile(coded: DataFrame, epoch: str = "ctime", offset_hours: int = 8) -> DataFrame:
    """(hour, coded, other) for all 24 hours; missing and zero times are left out."""
    hours = coded.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    n = coded.filter(F.col(epoch) != 0).groupBy(hour_of(F.col(epoch), offset_hours).alias("hour")).agg(F.count_if(F.size("codes") > 0).alias("coded"), F.count_if(F.size("codes") == 0).alias("other"))
    return hours.join(F.broadcast(n), "hour", "left").fillna(0, ["coded", "other"])


def length_coverage(coded: DataFrame, length: Column, short: int = 4) -> DataFrame:
    """(kind, n, coded) of short and long comments."""
    return coded.groupBy(F.when(length <= short, "short").otherwise("long").alias("kind")).agg(F.count("*").alias("n"), F.count_if(F.size("codes") > 0).alias("coded"))


def symbol_counts(coded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, category, n) by occurrences, (category, n) by comments)."""
    each = coded.select(F.explode("symbols").alias("s"))
    by_name = each.groupBy("s.name", "s.category").agg(F.count("*").alias("n"))
    kinds = coded.select(F.explode(F.array_distinct(F.transform("symbols", lambda s: s["category"]))).alias("category"))
    return by_name, kinds.groupBy("category").agg(F.count("*").alias("n"))


def symbol_dimensions(coded: DataFrame) -> DataFrame:
    """(category, dim, n): comments by symbol category and dimension."""
    kinds = F.array_distinct(F.transform("symbols", lambda s: s["category"]))
    return coded.filter(F.size("codes") > 0).select(F.explode(kinds).alias("category"), "dims").select("category", F.explode("dims").alias("dim")).groupBy("category", "dim").agg(F.count("*").alias("n"))


def symbol_binding(coded: DataFrame, dims: DataFrame, skip: str, least: int = 20, hits_least: int = 8, lift_least: float = 1.3, most: int = 24) -> DataFrame:
    """(name, n, dim, hits, lift, bound): the dimension that each frequent symbol leans to most.

    The rate is hits an occurrence, the base hits a comment with any symbol. dims: dim, ord; `skip` is left out. The best is by
    lift, then hits, then the dimensions' order; the `most` most frequent symbols are kept.
    """
    bearing = coded.filter(F.size("symbols") > 0)
    each = bearing.select(F.explode("symbols").alias("s"), "dims").select("s.name", "dims")
    n = each.groupBy("name").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    base = bearing.select(F.explode("dims").alias("dim")).groupBy("dim").agg(F.count("*").alias("base_hits")).crossJoin(F.broadcast(bearing.agg(F.count("*").alias("bearing"))))
    hits = each.select("name", F.explode("dims").alias("dim")).filter(F.col("dim") != skip).groupBy("name", "dim").agg(F.count("*").alias("hits"))
    scored = hits.join(n, "name").join(base, "dim").join(dims, "dim").withColumn("lift", ratio(F.col("hits") / F.col("n"), F.col("base_hits") / F.col("bearing")))
    best = scored.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy(F.desc("lift"), F.desc("hits"), "ord"))).filter("_r = 1")
    out = best.select("name", "n", "dim", "hits", "lift", ((F.col("lift") >= lift_least) & (F.col("hits") >= hits_least)).alias("bound"))
    return out.orderBy(F.desc("n"), "name").limit(most)


def concentration(counts: DataFrame, k: int = 3) -> DataFrame:
    """(code, n, videos, top_share, hhi, top): how far one video holds a code's comments. counts: code, video, n."""
    total = F.sum("n").over(Window.partitionBy("code"))
    rank = F.row_number().over(Window.partitionBy("code").orderBy(F.desc("n"), "video"))
    s = counts.withColumn("share", F.col("n") / total).withColumn("_r", rank)
    top = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") <= k, F.struct("_r", "video")))), lambda x: x["video"])
    return s.groupBy("code").agg(F.sum("n").alias("n"), F.count("*").alias("videos"), F.max("share").alias("top_share"), F.sum(F.col("share") * F.col("share")).alias("hhi"), top.alias("top"))


def headed(concentrated: DataFrame, few: int = 800, share: float = 0.2) -> DataFrame:
    """Codes whose support is thin: rarer than `few`, or a fifth or more from one video."""
    return concentrated.filter((F.col("n") < few) | (F.col("top_share") >= share))


def dominant(counts: DataFrame, keys: list[str], dim: str = "dim", order: str = "ord", n: str = "n") -> DataFrame:
    """(keys, dim): the dimension of the greatest positive count; the first in order wins ties."""
    return counts.filter(F.col(n) > 0).groupBy(*keys).agg(F.max_by(dim, F.struct(F.col(n), -F.col(order))).alias(dim))


def video_cards(coded: DataFrame, dims: DataFrame, k: int = 3) -> DataFrame:
    """(video, n, coded, dominant, top_symbols): one row a video; dominant is '' without any dimension."""
    n = coded.groupBy("video").agg(F.count("*").alias("n"), F.count_if(F.size("codes") > 0).alias("coded"))
    best = dominant(counts_by(coded, "dims", "dim", keys=["video"]).join(F.broadcast(dims), "dim"), ["video"]).withColumnRenamed("dim", "dominant")
    symbols = coded.select("video", F.explode("symbols").alias("s")).groupBy("video", "s.name").agg(F.count("*").alias("n"))
    ranked = symbols.withColumn("_r", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("n"), "name"))).filter(F.col("_r") <= k)
    top = ranked.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("top_symbols"))
    joined = n.join(best, "video", "left").join(top, "video", "left")
    return joined.withColumn("dominant", F.coalesce("dominant", F.lit(""))).withColumn("top_symbols", F.coalesce("top_symbols", F.array().cast("array<string>")))


def letter_pairs(rows: DataFrame) -> DataFrame:
    """(grp, video, gram, n): how often one letter a-z follows another, all else left out. rows: grp, video, text.

    A task keeps 676 counts a video, so what is shuffled depends on the videos and not on the length of the texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            rows = [(g, v, chr(97 + i // 26) + chr(97 + i % 26), int(c[i])) for (g, v), c in held.items() for i in np.flatnonzero(c)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["grp", "video", "gram", "n"])

        for b in batches:
            for g, v, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = np.frombuffer(text, np.uint8)
                x = x[(x >= 97) & (x <= 122)].astype(np.int64) - 97
                if len(x) > 1:
                    held[g, v] = held.get((g, v), 0) + np.bincount(x[:-1] * 26 + x[1:], minlength=676)
            if len(held) > 2000:
                yield flush()
        yield flush()

    each = rows.filter("text is not null").select(F.col("grp").cast("string"), F.col("video").cast("string"), F.col("text").cast("binary")).mapInArrow(run, "grp string, video string, gram string, n long")
    return each.groupBy("grp", "video", "gram").agg(F.sum("n").alias("n"))


def distinct_grams(grams: DataFrame, stop: str, least: int = 12, videos: int = 8, top_share: float = 0.5, z_least: float = 2.0, most: int = 6, total_least: int = 30) -> DataFrame:
    """(grp, gram, z, n, videos, top_share): grams that a group uses more than all others, by a two-proportion z.

    grams: grp, video, gram, n. Gates: enough grams on both sides, enough of the gram, in enough videos, not mostly in one, no stop characters.
    """
    by = grams.groupBy("grp", "gram").agg(F.sum("n").alias("n"), F.countDistinct("video").alias("videos"), F.max("n").alias("top"))
    size = by.groupBy("grp").agg(F.sum("n").alias("size"))
    every = size.agg(F.sum("size").alias("every"))
    whole = by.groupBy("gram").agg(F.sum("n").alias("whole"))
    x = by.join(size, "grp").join(whole, "gram").crossJoin(F.broadcast(every)).withColumn("rest", F.col("every") - F.col("size"))
    x = x.filter((F.col("size") >= total_least) & (F.col("rest") >= total_least) & (F.col("n") >= least) & (F.length("gram") >= 2) & (F.col("videos") >= videos) & (F.col("top") / F.col("n") <= top_share))
    if stop:
        x = x.filter(~F.col("gram").rlike(f"[{stop}]"))
    p = F.col("whole") / F.col("every")
    se = F.sqrt(p * (1 - p) * (1 / F.col("size") + 1 / F.col("rest")))
    x = x.filter((p > 0) & (p < 1)).withColumn("z", (F.col("n") / F.col("size") - (F.col("whole") - F.col("n")) / F.col("rest")) / se).filter(F.col("z") > z_least)
    ranked = x.withColumn("_r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("z"), F.desc("gram")))).filter(F.col("_r") <= most)
    return ranked.select("grp", "gram", F.round("z", 2).alias("z"), "n", "videos", F.round(F.col("top") / F.col("n"), 3).alias("top_share"))


def informative_grams(counts: DataFrame, dull: str, among: int = 80, most: int = 20) -> DataFrame:
    """The most frequent grams, without those of dull characters only. counts: gram, n."""
    top = counts.orderBy(F.desc("n"), "gram").limit(among)
    return top.filter(~F.col("gram").rlike(f"^[{dull}]*$")).orderBy(F.desc("n"), "gram").limit(most)


def nearest_ranks(rows: DataFrame, keys: list[str], value: str, p: float) -> DataFrame:
    """(keys, value): percentile by nearest rank, round-half-even of p (n - 1), of the values that are not null.

    Values are counted first, so a pool's task sorts its distinct values only.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("value")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumn("_upto", F.sum("n").over(w.orderBy("value"))).withColumn("_rank", F.bround(F.lit(p / 100) * (F.sum("n").over(w) - 1)))
    return upto.filter(F.col("_upto") > F.col("_rank")).groupBy(*keys).agg(F.min("value").alias("value"))


def dimension_support(coded: DataFrame, dims: DataFrame) -> DataFrame:
    """(dim, n, videos): comments of each dimension, and the videos where it is the dominant one; 0 where none. dims: dim, ord."""
    counts = counts_by(coded, "dims", "dim", keys=["video"]).join(F.broadcast(dims), "dim")
    n = counts.groupBy("dim").agg(F.sum("n").alias("n"))
    videos = dominant(counts, ["video"]).groupBy("dim").agg(F.count("*").alias("videos"))
    return dims.select("dim").join(n, "dim", "left").join(videos, "dim", "left").fillna(0, ["n", "videos"])


def pool_quality(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Row counters of each pool: empties, missing fields, repeated ids, units of time, seconds' range, modes, pages, lengths."""
    c = F.col("ctime")
    seconds = F.when(c > 10**12, c / 1000).otherwise(c).cast("double")
    usable = F.col("progress_ms").isNotNull() & c.isNotNull()
    text = F.coalesce("content", F.lit(""))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if(text == "").alias("empty"),
        F.count_if(F.col("progress_ms").isNull()).alias("no_progress"),
        F.count_if(c.isNull()).alias("no_ctime"),
        (F.count("id") - F.count_distinct("id")).alias("dup_id"),
        F.count_if(c > 10**12).alias("ctime_ms"),
        F.count_if((c > 10**9) & (c <= 10**12)).alias("ctime_s"),
        F.count_if(c <= 10**9).alias("ctime_other"),
        F.min(F.when(usable, seconds)).alias("ctime_min"),
        F.max(F.when(usable, seconds)).alias("ctime_max"),
        F.count_distinct("page").alias("pages"),
        F.count_if(usable).alias("usable"),
        F.percentile(F.when(text != "", F.length("content")), 0.5).alias("median_length"),
    )


def merged_quality(pools: DataFrame) -> DataFrame:
    """Counters of all pools as one row; a ratio without rows is null."""
    sums = [F.sum(c).alias(c) for c in ("rows", "empty", "no_progress", "no_ctime", "dup_id", "ctime_ms", "ctime_s", "ctime_other", "usable")]
    out = pools.agg(F.count("*").alias("pools"), *sums, F.min("ctime_min").alias("ctime_min"), F.max("ctime_max").alias("ctime_max"), F.count_if(F.col("pages") > 1).alias("several_pages"))
    return out.withColumn("usable_share", F.when(F.col("rows") > 0, F.col("usable") / F.col("rows")))


def pool_modes(rows: DataFrame) -> DataFrame:
    """(mode, n) over all pools; "none" where there is no mode."""
    return rows.groupBy(F.coalesce(F.col("mode").cast("string"), F.lit("none")).alias("mode")).agg(F.count("*").alias("n"))


def merged_ranks(values: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """One row (p50, ...) of nearest ranks over the values of all pools, which are counted, not gathered; null of none."""
    out = None
    for p in percents:
        one = nearest_ranks(values, [], value, p).agg(F.first("value").alias(f"p{p}"))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def merged_times(stats: DataFrame, bins: DataFrame) -> DataFrame:
    """Pools' time statistics as one row: rates over sums, null without a denominator. stats, bins: of premiere_stats(), minute_bins()."""
    rate = lambda a, b: F.when(F.sum(b) > 0, F.sum(a) / F.sum(b))
    a = stats.agg(F.count("*").alias("pools"), F.sum("usable").alias("usable"), rate("premiere_n", "usable").alias("premiere_share"), rate("inv_all", "adj_all").alias("inv_all"), rate("inv_pre", "adj_pre").alias("inv_premiere"), rate("gap7", "adj_all").alias("gap7"), F.avg((F.col("week_offset_days") < 14).cast("double")).alias("offset_lt_14"))
    b = bins.agg(F.count("*").alias("bins"), F.avg((F.col("span_days") > 7).cast("double")).alias("bin_span_gt7"), F.avg((F.abs(F.col("week_share") - F.col("premiere_share")) < 1e-9).cast("double")).alias("bin_majority_is_premiere"))
    return a.crossJoin(b)  # one row each


def ranges(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, least, middle, greatest)."""
    return values.groupBy(*keys).agg(F.min(value).alias("least"), F.median(value).alias("middle"), F.max(value).alias("greatest"))


def score_codes(pairs: DataFrame) -> DataFrame:
    """(code, tp, fp, fn, precision, recall, f1, support). pairs: truth array<string>, predicted array<string>."""
    each = pairs.select(F.explode(F.array_distinct(F.concat("truth", "predicted"))).alias("code"), "truth", "predicted")
    t, p = F.array_contains("truth", F.col("code")), F.array_contains("predicted", F.col("code"))
    s = each.groupBy("code").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    return with_f1(s).withColumn("support", F.col("tp") + F.col("fn"))


def with_f1(s: DataFrame) -> DataFrame:
    tp = F.col("tp")
    return s.withColumns({"precision": ratio(tp, tp + F.col("fp")), "recall": ratio(tp, tp + F.col("fn")), "f1": ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn"))})


def score_all(pairs: DataFrame) -> DataFrame:
    """(n, exact, micro_f1, macro_f1): one row; the macro mean is over codes that the truth has."""
    codes = score_codes(pairs)
    micro = codes.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg(F.when(F.col("support") > 0, F.col("f1"))).alias("macro_f1"))
    same = F.array_sort("truth") == F.array_sort("predicted")
    n = pairs.agg(F.count("*").alias("n"), F.avg(same.cast("double")).alias("exact"))
    return n.crossJoin(with_f1(micro).select(F.col("f1").alias("micro_f1"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1")))


def misses(pairs: DataFrame) -> DataFrame:
    """Rows whose labels differ, with what is missing and what is extra, sorted."""
    out = pairs.withColumns({"missing": F.array_sort(F.array_except("truth", "predicted")), "extra": F.array_sort(F.array_except("predicted", "truth"))})
    return out.filter((F.size("missing") > 0) | (F.size("extra") > 0))


def disagreement(pairs: DataFrame) -> DataFrame:
    """(code, model_only, rule_only). pairs: truth (rules), predicted (model)."""
    m = misses(pairs)
    each = m.select(F.explode("extra").alias("code"), F.lit(1).alias("m"), F.lit(0).alias("r")).unionByName(m.select(F.explode("missing").alias("code"), F.lit(0).alias("m"), F.lit(1).alias("r")))
    return each.groupBy("code").agg(F.sum("m").alias("model_only"), F.sum("r").alias("rule_only"))


def gap_fires(predicted: DataFrame) -> DataFrame:
    """(code, n, sample_n, fired_n): what a model finds in texts that no rule codes. predicted: predicted array<string>."""
    total = predicted.agg(F.count("*").alias("sample_n"), F.count_if(F.size("predicted") > 0).alias("fired_n"))
    return counts_by(predicted, "predicted", "code").crossJoin(F.broadcast(total))


def exemplars(coded: DataFrame, order: list[str], k: int = 8, text: str = "content") -> DataFrame:
    """(code, place, text): the first k texts of each code in scan order."""
    each = coded.select(F.explode("codes").alias("code"), *order, text)
    return each.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(*order))).filter(F.col("place") <= k).select("code", "place", text)
