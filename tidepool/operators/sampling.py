"""Deterministic samples: hash tickets, splits, nearest-threshold books, set operations on training texts, bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T


def hash_split(text: Column, parts: int = 5, held: int = 0) -> Column:
    """"eval" for a hashed part of texts, "train" for the rest."""
    return F.when(T.stable_hash(F.concat(F.lit("split:"), text)) % parts == held, "eval").otherwise("train")


def places(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with `seen`: the place in scan order within keys, from 1."""
    return df.withColumn("seen", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def reservoir(df: DataFrame, text: str, keys: list[str], order: list[str], cap: int) -> DataFrame:
    """(keys, slot, text): a reservoir of hash tickets over texts in scan order.

    The first `cap` fill the slots; the n-th after that enters if its hash modulo n is below cap, at its slot hash; the last
    one to enter a slot stays. That depends on the order, hence the numbering; all that follows is one aggregation.
    """
    seen = places(df, keys, order)
    h, slot = T.stable_hash(F.col(text)), T.stable_hash(F.concat(F.lit("slot:"), F.col(text))) % cap
    at = F.when(F.col("seen") <= cap, F.col("seen") - 1).when(h % F.col("seen") < cap, slot)
    return seen.withColumn("slot", at).filter("slot is not null").groupBy(*keys, "slot").agg(F.max_by(text, "seen").alias(text))


def margin_book(scores: DataFrame, keys: list[str], n: int, text: str = "text", distance: str = "distance", merged: bool = True) -> DataFrame:
    """The n texts nearest to a threshold, each with its least distance; ties by text, nulls last. Unless merged, equal texts stay rows of their own."""
    least = scores.groupBy(*keys, text).agg(F.min(distance).alias(distance)) if merged else scores.select(*keys, text, distance)
    order = [F.col(distance).asc_nulls_last(), F.col(text).asc_nulls_last()]
    if not keys:
        least = least.orderBy(*order).limit(n)  # n rows are numbered in one task, not all
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return least.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def nearest(probability: Column, thresholds: Column) -> Column:
    """The least distance of an array of probabilities to an array of thresholds."""
    return F.array_min(F.zip_with(probability, thresholds, lambda p, t: F.abs(p - t)))


def merged_labels(*sets: DataFrame) -> DataFrame:
    """Training sets as one: one row a text with all its labels."""
    both = sets[0].select("text", "labels")
    for s in sets[1:]:
        both = both.unionByName(s.select("text", "labels"))
    return both.groupBy("text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"))


def first_set_wins(*sets: DataFrame) -> DataFrame:
    """The union of sets (text, labels, ord), each text as the first set, then the first place, has it."""
    ranked = [s.select("text", "labels", "ord", F.lit(i).alias("source")) for i, s in enumerate(sets)]
    both = ranked[0]
    for s in ranked[1:]:
        both = both.unionByName(s)
    return both.groupBy("text").agg(F.min_by(F.struct("source", "ord", "labels"), F.struct("source", "ord")).alias("f")).select("text", "f.labels", "f.source")


def counts_less(a: DataFrame, b: DataFrame, key: str, n: str = "n") -> DataFrame:
    """Counts of a less those of b; what is not positive is dropped."""
    return a.join(b.select(key, F.col(n).alias("_b")), key, "left").withColumn(n, F.col(n) - F.coalesce("_b", F.lit(0))).drop("_b").filter(F.col(n) > 0)


def draws(units: DataFrame, unit: str, n_draws: int, n_units: int) -> DataFrame:
    """(draw, unit, times): cluster bootstrap, with replacement, as many as there are units, by hash instead of a random stream.

    units: unit, place 0..n_units-1. Draw d's k-th pick is the unit whose place is a hash of (d, k) modulo n_units, so the
    multiplicities are the same wherever they are computed. Size: n_draws * n_units rows before counting.
    """
    spark = units.sparkSession
    picks = spark.range(n_draws * n_units).select(F.expr(f"id div {max(n_units, 1)}").alias("draw"), (F.col("id") % max(n_units, 1)).alias("k"))
    place = T.stable_hash(F.concat_ws(":", F.col("draw").cast("string"), F.col("k").cast("string"))) % n_units
    times = picks.select("draw", place.alias("place")).groupBy("draw", "place").agg(F.count("*").alias("times"))
    return times.join(units.select(unit, "place"), "place").select("draw", unit, "times")


def bootstrap_lifts(counts: DataFrame, picked: DataFrame, unit: str, group: str, code: str) -> DataFrame:
    """(draw, group, code, lift) over resampled units. counts: unit, group, code, hits, n (rows of the unit)."""
    drawn = counts.join(picked, unit)
    sums = drawn.groupBy("draw", group, code).agg(F.sum(F.col("hits") * F.col("times")).alias("hits"))
    sizes = counts.select(unit, group, "n").distinct().join(picked, unit).groupBy("draw", group).agg(F.sum(F.col("n") * F.col("times")).alias("n"))
    of_group = sums.join(sizes, ["draw", group])
    base_hits = sums.groupBy("draw", code).agg(F.sum("hits").alias("all_hits"))
    base_n = sizes.groupBy("draw").agg(F.sum("n").alias("all_n"))
    rate, base = F.col("hits") / F.col("n"), F.col("all_hits") / F.col("all_n")
    joined = of_group.join(base_hits, ["draw", code]).join(base_n, "draw")
    return joined.select("draw", group, code, F.when(base > 0, rate / base).otherwise(0.0).alias("lift"))


def intervals(lifts: DataFrame, keys: list[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(keys, low, high, above_one): linear percentiles of lifts over draws, and the share of draws above 1."""
    return lifts.groupBy(*keys).agg(F.percentile("lift", low).alias("low"), F.percentile("lift", high).alias("high"), F.avg((F.col("lift") > 1).cast("double")).alias("above_one"))


def bootstrap_bindings(counts: DataFrame, picked: DataFrame, unit: str, locked: DataFrame, lift_least: float = 1.3) -> DataFrame:
    """(name, dim, low, high, share_bound) of symbols' lifts over draws, each with the dimension that it has in the whole.

    counts: unit, name, dim, hits (of the symbol with the dimension), n (of the symbol), base_hits, bearing (the unit's comments with
    any symbol: of the dimension, and all). locked: name, dim.
    """
    drawn = counts.join(locked, ["name", "dim"]).join(picked, unit)
    s = drawn.groupBy("draw", "name", "dim").agg(F.sum(F.col("hits") * F.col("times")).alias("hits"), F.sum(F.col("n") * F.col("times")).alias("n"))
    bases = counts.select(unit, "dim", "base_hits", "bearing").distinct().join(picked, unit).groupBy("draw", "dim").agg(F.sum(F.col("base_hits") * F.col("times")).alias("base_hits"), F.sum(F.col("bearing") * F.col("times")).alias("bearing"))
    base = F.when(F.col("bearing") > 0, F.col("base_hits") / F.col("bearing")).otherwise(0.0)
    rate = F.when(F.col("n") > 0, F.col("hits") / F.col("n")).otherwise(0.0)
    lift = s.join(bases, ["draw", "dim"]).withColumn("lift", F.when(base > 0, rate / base).otherwise(0.0))
    return lift.groupBy("name", "dim").agg(F.percentile("lift", 0.025).alias("low"), F.percentile("lift", 0.975).alias("high"), F.avg((F.col("lift") >= lift_least).cast("double")).alias("share_bound"))
