"""Predicates and filters over comments, titles and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.coding import any_of


def in_scope(title: Column, count: Column, least: int = 0, contains: str = "", any_words: list[str] = (), exclude: list[str] = ()) -> Column:
    """A video counts: enough comments, a title with a word, one of some words, none of others. Null counts are 0."""
    clean = T.clean_title(title)
    some = any_of(clean, [w for w in any_words if w]) if any_words else F.lit(True)
    return (F.coalesce(count, F.lit(0)) >= least) & F.contains(clean, F.lit(contains)) & some & ~any_of(clean, [w for w in exclude if w])


def pruned(videos: DataFrame, specs: DataFrame, exclude: list[str]) -> DataFrame:
    """Videos that still pass the title rules: those for all, and those of their query (unknown query: only those for all).

    videos: title, query; specs: keyword, title_contains, title_any, title_exclude.
    """
    spec = specs.select(F.col("keyword").alias("query"), "title_contains", "title_any", "title_exclude")
    clean = T.clean_title(F.col("title"))
    none = F.array().cast("array<string>")
    words = lambda c: F.filter(F.coalesce(F.col(c), none), lambda w: w != "")
    own = F.contains(clean, F.coalesce("title_contains", F.lit(""))) & ((F.size(words("title_any")) == 0) | F.exists(words("title_any"), lambda w: F.contains(clean, w))) & ~F.exists(words("title_exclude"), lambda w: F.contains(clean, w))
    return videos.join(spec, "query", "left").filter(~any_of(clean, exclude) & own).select(*videos.columns)


def pages_until_below(rows: DataFrame, least: int, page: str = "page", place: str = "ord", count: str = "count", keys: list[str] = ()) -> DataFrame:
    """Rows of a list sorted by count, up to the first page whose first row is below the threshold."""
    first = Window.partitionBy(*keys, page).orderBy(place)
    low = Window.partitionBy(*keys).orderBy(page).rangeBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_head", F.first(count).over(first)).withColumn("_low", F.min("_head").over(low)).filter(F.col("_low") >= least).drop("_head", "_low")


def stripped_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def margin_candidate(codes: Column, text: Column, laugh: str, low: int = 4, high: int = 40) -> Column:
    """Without codes, no laughter, of a stripped length within bounds."""
    return (F.size(codes) == 0) & ~T.is_laugh(text, laugh) & stripped_length(text).between(low, high)


def gap_candidate(codes: Column, text: Column, laugh: str, parts: int = 8) -> Column:
    """The hashed eighth of the margin candidates that is held back from training."""
    return margin_candidate(codes, text, laugh) & (T.stable_hash(F.concat(F.lit("gap:"), text)) % parts == 0)


def residue(codes: Column, text: Column, laugh: str, parts: int = 3, low: int = 4, high: int = 40) -> Column:
    """The hashed third of comments without codes whose unstripped length is within bounds."""
    return (F.size(codes) == 0) & ~T.is_laugh(text, laugh) & F.length(text).between(low, high) & (T.stable_hash(text) % parts == 0)


def negative_candidate(codes: Column, text: Column, laugh: str) -> Column:
    return (F.size(codes) == 0) & ~gap_candidate(codes, text, laugh) & (stripped_length(text) >= 2)


def is_ritual(norm: Column, ritual: list[str], chars: str) -> Column:
    """One character at most, a ritual phrase, or nothing but the given characters."""
    return (F.length(norm) <= 1) | norm.isin(*(ritual or [""])) | norm.rlike(f"^[{chars}]*$")


def answer_rows(rows: DataFrame, ritual: list[str], chars: str, said: int = 4) -> DataFrame:
    """Rows that go on about the matter: no ritual, a key in the content, enough left of the normal form without those keys.

    rows: content, norm, keys array<string>.
    """
    hit = F.filter("keys", lambda k: F.contains(F.col("content"), k))
    rest = T.remainder(F.col("norm"), F.transform(hit, T.normalize))
    return rows.filter(~is_ritual(F.col("norm"), ritual, chars) & (F.size(hit) > 0)).withColumn("_rest", rest).filter((F.length("_rest") >= said) & ~F.col("_rest").rlike(f"^[{chars}]*$")).drop("_rest")


def title_keys(title: Column, pool: Column, show: list[str], matter: list[str], asking_pools: list[str], marks: list[str], stop: list[str], keep: str = r"\p{IsHan}") -> Column:
    """What a title is about: matter words unless it announces a show; in the asking pools, short words of a title that asks."""
    none = F.array().cast("array<string>")
    public = F.when(any_of(title, show), none).otherwise(T.maximal_keys(title, matter))
    short = F.when(any_of(title, marks), T.short_keys(title, marks, stop, keep)).otherwise(none)
    return F.when(F.size(public) > 0, public).when(pool.isin(*(asking_pools or [""])), short).otherwise(none)


def page_kind(track: Column, title: Column, categories: Column, common_track: str, overview: str, rules: list[str], nav: list[int], marks: dict[str, str]) -> Column:
    """The kind of a page by ordered rules."""
    t = F.coalesce(title, F.lit(""))
    kind = F.when(track == common_track, "guide").when(F.contains(t, F.lit(overview)), "overview").when(any_of(t, rules), "rules")
    kind = kind.when(F.arrays_overlap(F.coalesce(categories, F.array().cast("array<int>")), F.array(*map(F.lit, nav))), "nav")
    for mark, name in marks.items():
        kind = kind.when(F.contains(t, F.lit(mark)), name)
    return kind.otherwise("problem")


def silver_faults(silver: DataFrame, codes: list[str]) -> DataFrame:
    """(fault, n): unknown labels, blank texts, and too few rows; empty if the set is valid."""
    unknown = F.size(F.array_except("labels", F.array(*map(F.lit, codes)))) > 0
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    counts = silver.agg(F.count_if(unknown).alias("unknown label"), F.count_if(blank).alias("blank text"), F.when(F.count("*") < 2, 1).otherwise(0).cast("long").alias("fewer than two rows"))
    return counts.selectExpr("stack(3, 'unknown label', `unknown label`, 'blank text', `blank text`, 'fewer than two rows', `fewer than two rows`) as (fault, n)").filter("n > 0")


def leaked(training: DataFrame, gold: DataFrame) -> DataFrame:
    """Texts of the training set that the gold set has too."""
    return training.select("text").distinct().join(gold.select("text").distinct(), "text", "left_semi")
