"""Tables behind a report: rates, shares, signatures, flows, matrices, search, sentences; and a plain HTML page of them."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_10k(n: Column, of: Column) -> Column:
    return F.when(of > 0, n * 10000 / of).otherwise(0.0)


def composition(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """counts with `share` of its key's total."""
    total = F.sum(n).over(Window.partitionBy(*keys))
    return counts.withColumn("share", F.when(total > 0, F.col(n) / total).otherwise(0.0))


def signatures(lifts: DataFrame, least: int = 20, lift: float = 1.3, most: int = 12) -> DataFrame:
    """Group and code pairs that stand out."""
    return lifts.filter((F.col("n") >= least) & (F.col("lift") >= lift)).orderBy(F.desc("lift"), "grp", "code").limit(most)


def flows(steps: DataFrame, least: int = 8) -> DataFrame:
    """Transitions between different dimensions, frequent enough."""
    return steps.filter((F.col("a") != F.col("b")) & (F.col("n") >= least)).orderBy(F.desc("n"), "a", "b")


def hour_shares(profile: DataFrame) -> DataFrame:
    """(hour, coded, other) as shares of their day."""
    t = profile.agg(F.sum("coded").alias("_c"), F.sum("other").alias("_o"))
    return profile.crossJoin(F.broadcast(t)).select("hour", *[F.when(F.col(f"_{c[0]}") > 0, F.col(c) / F.col(f"_{c[0]}")).otherwise(0.0).alias(c) for c in ("coded", "other")])


def named_modes(modes: DataFrame, names: dict[int, str], other: str = "other") -> DataFrame:
    name = F.lit(other)
    for mode, text in names.items():
        name = F.when(F.col("mode") == mode, text).otherwise(name)
    return modes.withColumn("name", name)


def matrix(pairs: DataFrame, names: list[str], value: str = "n") -> DataFrame:
    """Long (a, b, value) as a row for each a and a column for each name; absent pairs are 0."""
    return pairs.groupBy("a").pivot("b", names).agg(F.first(value)).fillna(0)


def card_search(cards: DataFrame, words: str, columns: tuple[str, ...] = ("title", "video"), most: int = 8) -> DataFrame:
    """The first cards whose title or id holds the words, case folded."""
    low = F.lower(F.lit(words.strip()))
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.col(c).cast("string")), low)
    return cards.filter(hit).orderBy(*columns).limit(most)


def findings(lifts: DataFrame, arcs: DataFrame, stays: DataFrame, concentrated: DataFrame) -> DataFrame:
    """(kind, subject, value, sentence): what a report says of the aggregates, each under its threshold."""
    pick = lambda df, kind, subject, value, text: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"), text.alias("sentence"))
    up = lifts.filter((F.col("n") >= 20) & (F.col("lift") >= 1.3))
    s = F.concat_ws(" ", F.col("code"), F.lit("is"), F.round("lift", 2).cast("string"), F.lit("times as frequent in group"), F.col("grp").cast("string"))
    moves = arcs.filter(F.abs("delta") > 0.005)
    m = F.concat_ws(" ", F.col("dim"), F.when(F.col("delta") > 0, "rises").otherwise("falls"), F.lit("towards the end"))
    keep = stays.filter("stay >= 0.5")
    k = F.concat_ws(" ", F.col("a"), F.lit("follows itself in"), F.round(F.col("stay") * 100, 1).cast("string"), F.lit("% of steps"))
    thin = concentrated.filter((F.col("videos") >= 3) & (F.col("top_share") >= 0.5))
    t = F.concat_ws(" ", F.lit("one video holds"), F.round(F.col("top_share") * 100, 1).cast("string"), F.lit("% of"), F.col("code"))
    out = pick(up, "signature", F.col("code"), F.col("lift"), s).unionByName(pick(moves, "arc", F.col("dim"), F.col("delta"), m))
    return out.unionByName(pick(keep, "stay", F.col("a"), F.col("stay"), k)).unionByName(pick(thin, "concentration", F.col("code"), F.col("top_share"), t))


def headlines(totals: DataFrame, dims: DataFrame, codes: DataFrame, numbers: dict[str, DataFrame]) -> DataFrame:
    """(kind, subject, value): the sentences of a report that name one number: coded share, share of several codes, laughter among the
    uncoded, the most frequent dimension and code (first by name on ties), and single numbers that are above 0. totals: of totals();
    dims, codes: name, n; numbers: one row `n` each."""
    pick = lambda df, kind, subject, value: df.select(F.lit(kind).alias("kind"), subject.alias("subject"), value.cast("double").alias("value"))
    none = F.lit("")
    some = totals.filter("comments > 0")
    out = pick(some, "coded", none, F.col("coded") / F.col("comments"))
    out = out.unionByName(pick(some.filter("coded > 0"), "several codes", none, F.col("multi") / F.col("coded")))
    out = out.unionByName(pick(some.filter("unlabeled > 0"), "laughter", none, F.col("laugh") / F.col("unlabeled")))
    for kind, counts in (("top dimension", dims), ("top code", codes)):
        out = out.unionByName(pick(counts.filter("n > 0").orderBy(F.desc("n"), "name").limit(1), kind, F.col("name"), F.col("n")))
    for kind, df in numbers.items():
        out = out.unionByName(pick(df.filter("n > 0"), kind, none, F.col("n")))
    return out


def html_report(path: str, title: str, tables: dict[str, DataFrame], most: int = 200) -> None:
    """A page of small aggregate tables; all cells are escaped. Refuses columns of raw text. Written by the driver."""
    parts = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        if bad := {"content", "norm"} & set(df.columns):
            raise ValueError(f"a report must not hold raw text: {sorted(bad)}")
        rows = df.limit(most + 1).collect()
        more = f"<p>only the first {most} rows are shown" if len(rows) > most else ""
        rows = rows[:most]
        head = "".join(f"<th>{html.escape(c)}" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}" for x in r) for r in rows)
        parts.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}{body}</table>{more}")
    Path(path).write_text("\n".join(parts), encoding="utf-8")
