"""A character n-gram classifier: one logistic model a code over hashed features; thresholds, scores, agreement.

Weights are a table (code, bucket, w); bucket -1 is the bias. Scoring is a join and a sum, so texts of any number are scored
without Python. Training is sequential by nature, in one task a code: its features are in a temporary file there, so that memory holds
16 bytes a row and the weights, and its time grows with the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import text as T
from tidepool.operators.aggregates import disagreement, score_all
from tidepool.operators.sampling import hash_split, merged_labels


def featured(texts: DataFrame, n_features: int = 1 << 15, text: str = "text") -> DataFrame:
    return texts.withColumn("buckets", T.feature_buckets(F.col(text), n_features))


def fit(train: DataFrame, codes: list[str], epochs: int = 10, rate: float = 0.15, decay: float = 1e-4, n_features: int = 1 << 15) -> DataFrame:
    """(code, bucket, w) of one-vs-rest logistic regressions by stochastic gradient descent. train: text, labels.

    Positives weigh (n - p) / p, within 1 and 6; logits are clipped at 20; weights shrink after each epoch; a seeded shuffle.
    """
    def model(x, ends, y):
        import numpy as np

        positive = y.sum()
        weight = np.clip((len(y) - positive) / positive, 1, 6) if positive else 1.0
        w, bias, shuffle = np.zeros(n_features), 0.0, np.random.default_rng(0)
        for _ in range(epochs):
            for i in shuffle.permutation(len(y)):
                row = x[ends[i] : ends[i + 1]]
                z = np.clip(w[row].sum() + bias, -20, 20)
                step = rate * (y[i] - 1 / (1 + np.exp(-z))) * (weight if y[i] else 1.0)
                w[row] += step
                bias += step
            w *= 1 - decay
        at = np.flatnonzero(w)
        return np.append(at, -1), np.append(w[at], bias)

    def descend(batches):
        """Rows sorted by code, then text: the weights of each code."""
        import tempfile
        from array import array

        import numpy as np
        import pyarrow as pa

        def trained():
            file.flush()
            x = np.memmap(file, np.int32, "r").view(np.ndarray) if ends[-1] else np.empty(0, np.int32)
            bucket, w = model(x, np.frombuffer(ends, np.int64), np.frombuffer(y))
            file.close()
            return pa.RecordBatch.from_arrays([pa.array([code] * len(w), pa.string()), pa.array(bucket, pa.int64()), pa.array(w, pa.float64())], ["code", "bucket", "w"])

        code = file = ends = y = None
        for b in batches:
            for c, buckets, label in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                if c != code:
                    if file:
                        yield trained()
                    code, file, ends, y = c, tempfile.TemporaryFile(), array("q", [0]), array("d")
                row = buckets.values.to_numpy().astype(np.int32)
                file.write(row.tobytes())
                ends.append(ends[-1] + len(row))
                y.append(label)
        if file:
            yield trained()

    wide = featured(train, n_features).select("text", "buckets", "labels", F.explode(F.array(*map(F.lit, codes))).alias("code"))
    rows = wide.select("code", "buckets", F.array_contains("labels", F.col("code")).cast("int").alias("y"), "text")
    return rows.repartition(len(codes), "code").sortWithinPartitions("code", "text").select("code", "buckets", "y").mapInArrow(descend, "code string, bucket long, w double")


def scores(texts: DataFrame, weights: DataFrame, n_features: int = 1 << 15, text: str = "text") -> DataFrame:
    """(text, code, p): probabilities of every code."""
    each = featured(texts.select(text).distinct(), n_features, text).select(text, F.explode(F.concat("buckets", F.array(F.lit(-1).cast("long")))).alias("bucket"))
    z = each.join(F.broadcast(weights), "bucket")  # at most n_features + 1 rows a code
    z = z.groupBy(text, "code").agg(F.sum("w").alias("z"))
    return z.select(text, "code", (1 / (1 + F.exp(-F.least(F.greatest("z", F.lit(-20.0)), F.lit(20.0))))).alias("p"))


def grid_thresholds(scored: DataFrame, low: float = 0.1, high: float = 0.9, step: float = 0.05, never: float = 0.99) -> DataFrame:
    """(code, threshold): the first of a grid with the best F1; `never` for codes without a positive. scored: code, p, y."""
    grid = [round(low + i * step, 10) for i in range(int(round((high - low) / step)) + 1)]
    at = scored.withColumn("t", F.explode(F.array(*map(F.lit, grid))))
    hit = F.col("p") >= F.col("t")
    c = at.groupBy("code", "t").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))
    f1 = F.when(F.col("tp") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).otherwise(0.0)
    best = c.groupBy("code").agg(F.max_by("t", F.struct(f1, -F.col("t"))).alias("t"), F.max(F.col("tp") + F.col("fn")).alias("positives"))
    return best.select("code", F.when(F.col("positives") > 0, F.col("t")).otherwise(never).alias("threshold"))


def predicted(scored: DataFrame, thresholds: DataFrame, text: str = "text") -> DataFrame:
    """(text, predicted array): codes whose probability reaches their threshold."""
    hit = F.when(F.col("p") >= F.col("threshold"), F.col("code"))
    return scored.join(F.broadcast(thresholds), "code").groupBy(text).agg(F.array_sort(F.collect_list(hit)).alias("predicted"))


def agreement(positives: DataFrame, negatives: DataFrame, codes: list[str], least: int = 40, least_train: int = 30, least_eval: int = 8) -> tuple[DataFrame, DataFrame] | None:
    """(scores, disagreement) of a model with the rules that labelled its texts, on a hashed fifth; None where texts are too few."""
    rows = merged_labels(positives, negatives).withColumn("part", hash_split(F.col("text")))
    n = {r["part"]: r["count"] for r in rows.groupBy("part").count().collect()}
    if sum(n.values()) < least or n.get("train", 0) < least_train or n.get("eval", 0) < least_eval:
        return None
    weights = fit(rows.filter("part = 'train'"), codes, epochs=6)
    held = rows.filter("part = 'eval'")
    own = scores(rows, weights).join(rows, "text").withColumn("y", F.array_contains("labels", F.col("code")).cast("int"))
    pairs = held.select("text", F.col("labels").alias("truth")).join(predicted(scores(held, weights), grid_thresholds(own.filter("part = 'train'"))), "text", "left")
    pairs = pairs.withColumn("predicted", F.coalesce("predicted", F.array().cast("array<string>")))
    return score_all(pairs), disagreement(pairs)


def redacted(df: DataFrame, text_columns: tuple[str, ...] = ("text", "content", "norm")) -> DataFrame:
    """Without columns of raw text."""
    return df.drop(*text_columns)


def probability(margin: Column) -> Column:
    return 1 / (1 + F.exp(-margin))
