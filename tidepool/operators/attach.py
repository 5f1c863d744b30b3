"""One pass of a model over a corpus: batched predictions, what they disagree on, what lies near a threshold."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.aggregates import disagreement
from tidepool.operators.sampling import margin_book, nearest

Score = Callable[[list[str]], np.ndarray]


def in_smaller_batches(run: Callable[[int], object], batch: int, fault: type[BaseException] = MemoryError) -> tuple[object, int]:
    """run(batch), with half the batch after each fault of that type; the fault itself at a batch of one."""
    while True:
        try:
            return run(batch), batch
        except fault:
            if batch <= 1:
                raise
            batch //= 2


def batched(score: Score, texts: list[str], batch: int) -> np.ndarray:
    """Scores of texts, batch by batch; a batch that does not fit is halved, and so are those after it."""
    out, at = [], 0
    while at < len(texts):
        done, batch = in_smaller_batches(lambda n, a=at: score(texts[a : a + n]), batch)
        out.append(done)
        at += batch
    return np.concatenate(out) if out else np.empty((0, 0))


def scored(texts: DataFrame, make: Callable[[], Score], codes: list[str], batch: int = 256, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """texts with `probabilities`, one for each code. make() is called once a task, where a model is loaded."""
    kept = texts.select(text, *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = None
        for b in batches:
            score = score or make()
            p = batched(score, [t or "" for t in b.column(0).to_pylist()], batch)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([list(map(float, r)) for r in p], pa.list_(pa.float64()))], [*b.schema.names, "probabilities"])

    from pyspark.sql.types import ArrayType, DoubleType, StructType

    schema = StructType(list(kept.schema.fields)).add("probabilities", ArrayType(DoubleType()))
    return kept.mapInArrow(run, schema)


def decided(predictions: DataFrame, codes: list[str], thresholds: list[float]) -> DataFrame:
    """predictions with `predicted` (codes that reach their thresholds) and `distance` to the nearest threshold."""
    t = F.array(*map(F.lit, thresholds))
    named = F.zip_with(F.zip_with("probabilities", t, lambda p, x: p >= x), F.array(*map(F.lit, codes)), lambda hit, c: F.when(hit, c))
    return predictions.withColumns({"predicted": F.filter(named, lambda c: c.isNotNull()), "distance": nearest(F.col("probabilities"), t)})


def folded(predictions: DataFrame, n: int = 200, merged: bool = True) -> tuple[DataFrame, DataFrame]:
    """(disagreement by code, the n texts nearest a threshold; unless merged, n rows). predictions: text, truth, predicted, distance."""
    return disagreement(predictions), margin_book(predictions.filter(F.size("truth") == 0), [], n, merged=merged)


def by_code(predictions: DataFrame, codes: list[str], thresholds: list[float], n: int = 50) -> DataFrame:
    """(code, text, distance, place): for each code the n texts nearest its threshold."""
    each = F.zip_with(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(t).alias("t")) for c, t in zip(codes, thresholds, strict=True)]), F.col("probabilities"), lambda c, p: F.struct(c["code"].alias("code"), F.abs(p - c["t"]).alias("distance")))
    rows = predictions.select("text", F.explode(each).alias("e")).select("text", "e.code", "e.distance")
    return margin_book(rows, ["code"], n)
