"""What viewers answer to a film's question: lines said again, pieces shared by many lines, matters over films."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T


def choruses(rows: DataFrame, keys: list[str], k: int = 3, order: str = "ord") -> DataFrame:
    """(keys, text, n, place): normal forms said twice or more, worded as most often written (first seen on ties). rows: norm, content, ord."""
    worded = rows.groupBy(*keys, "norm", "content").agg(F.count("*").alias("c"), F.min(order).alias("first"))
    g = worded.groupBy(*keys, "norm").agg(F.sum("c").alias("n"), F.max_by("content", F.struct(F.col("c"), -F.col("first"))).alias("text")).filter("n >= 2")
    return g.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "text"))).filter(F.col("place") <= k).select(*keys, "text", "n", "place")


def shared_pieces(rows: DataFrame, keys: list[str], low: int = 4, high: int = 8, least: int = 4, k: int = 3) -> DataFrame:
    """(keys, piece, n, place): substrings that many rows share, none within a longer one that is as frequent, none that leads into one before.

    rows: norm, matter array<string>. Pieces that overlap a key of the matter do not count. Only pieces, never lines, are compared.
    """
    pieces = F.array_distinct(F.concat(*[T.grams(F.col("norm"), n) for n in range(low, high + 1)]))
    each = rows.withColumn("piece", F.explode(pieces)).filter(~T.overlaps_key(F.col("piece"), F.col("matter")))
    counts = each.groupBy(*keys, "piece").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    within = counts.withColumn("part", F.explode(F.concat(*[T.grams(F.col("piece"), n) for n in range(low, high)]))).filter("part <> piece").groupBy(*keys, F.col("part").alias("piece")).agg(F.max("n").alias("held_n"))
    left = counts.join(within, [*keys, "piece"], "left").filter("held_n is null or held_n < n").select(*keys, "piece", "n")
    best = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc(F.length("piece")), "piece")
    out = None
    for place in range(1, k + 1):
        ranked = left.withColumn("_r", F.row_number().over(best))
        chosen = ranked.filter("_r = 1").select(*keys, "piece", "n", F.lit(place).alias("place"))
        out = chosen if out is None else out.unionByName(chosen)
        left = ranked.filter("_r > 1").join(chosen.select(*keys, F.col("piece").alias("_kept")), keys).filter(~T.lead_in(F.col("piece"), F.col("_kept"))).select(*keys, "piece", "n")
    return out


def affairs(lines: DataFrame, most: int = 3) -> DataFrame:
    """(affair, film, text, n, place): repeated lines under the longest key that they name, else the longest of the film's. lines: film, text, n, matter."""
    hit = F.filter("matter", lambda m: F.contains(F.col("text"), m))
    pool = F.when(F.size(hit) > 0, hit).otherwise(F.col("matter"))
    longest = F.element_at(F.array_sort(pool, lambda a, b: F.when(F.length(b) != F.length(a), F.length(b) - F.length(a)).otherwise(F.array_position("matter", a) - F.array_position("matter", b)).cast("int")), 1)
    x = lines.filter(F.size("matter") > 0).withColumn("affair", longest)
    return x.withColumn("place", F.row_number().over(Window.partitionBy("affair", "film").orderBy(F.desc("n"), "text"))).filter(F.col("place") <= most).select("affair", "film", "text", "n", "place")


def unsettled(answers: DataFrame, settled: DataFrame, least: int = 8, most: int = 8) -> DataFrame:
    """(film, n): films with answers enough but no line said twice. answers: film; settled: film."""
    n = answers.groupBy("film").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return n.join(settled, "film", "left_anti").orderBy(F.desc("n"), "film").limit(most)


def coverage(films: DataFrame, answers: DataFrame) -> DataFrame:
    """(pool, seen, passed, answers): films, those with a matter, answers found. films: pool, film, matter; answers: pool."""
    f = films.groupBy("pool").agg(F.count("*").alias("seen"), F.count_if(F.size("matter") > 0).alias("passed"))
    return f.join(answers.groupBy("pool").agg(F.count("*").alias("answers")), "pool", "left").fillna(0, ["answers"])


def direction(hubs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sentence) of the lines that recur most. hubs: text, place."""
    quoted = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda h: F.concat(F.lit('"'), h["text"], F.lit('"'))), ", ")
    return hubs.filter("place <= 3").groupBy(*keys).agg(F.concat(F.lit("Said again and again: "), quoted).alias("sentence"))
