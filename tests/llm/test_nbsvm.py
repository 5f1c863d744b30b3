import random
import zlib

from pyspark.sql import functions as F

from tidepool.llm import nbsvm as N


def test_learns_and_never_sees_held_out_labels(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        words = [rng.choice("lorem ipsum dolor sit amet vita nova".split()) for _ in range(rng.randrange(5, 40))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        labels.append((i, int(good)))
    docs, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    out = N.scored(docs, N.learned(docs, y)).join(y, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert len(held) > 40 and sum(r.predicted == r.quality for r in held) / len(held) > 0.97
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = y.withColumn("quality", F.when(held_out, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = N.scored(docs, N.learned(docs, flipped)).collect()
    assert sorted((r.doc_id, r.score) for r in again) == sorted((r.doc_id, r.score) for r in out)


def test_sampling_is_bounded_and_odd_rows_pass(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (6, None), (None, 1), (7, 0)], "doc_id long, quality int")
    model = N.learned(odd_documents, labels)
    rows = N.scored(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4, 5)}) == 1
    assert N.scored(no_documents, model).count() == 0
    assert N.good_only(odd_documents, labels).columns == odd_documents.columns
    nothing = N.learned(odd_documents, labels.limit(0))
    assert {r.score for r in N.scored(odd_documents, nothing).collect()} == {0.5}


def test_descent_meets_the_optimality_conditions():
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 50, 12)) for _ in range(200)]
    y = np.array([1 if len(set(r) & {1, 2, 3, 4, 5, 6, 7}) > 1 else -1 for r in rows])
    r = N.ratios(rows, y)
    w, bias = N.dual_descent(rows, y, r, rounds=2000, tolerance=1e-6)
    value = lambda w, b: 0.5 * (w @ w + b * b) + sum(max(0, 1 - t * (w[f] @ r[f] + b)) for f, t in zip(rows, y, strict=True))
    best = value(w, bias)
    for _ in range(50):
        step = rng.normal(size=N.BUCKETS) * 1e-3
        assert value(w + step * (np.abs(w) > 0), bias + rng.normal() * 1e-3) >= best - 1e-6


def test_scores_equal_a_slow_computation(spark, odd_documents):
    """Each score from the text's n-grams as strings, one by one; an n-gram never learned from weighs nothing."""
    import math
    import re

    import numpy as np
    import xxhash

    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("Alpha beta gamma delta 17 x! x! zeta".split(), k=rng.randrange(3, 30)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = N.learned(docs, spark.createDataFrame([(i, int("gamma beta" in t)) for i, t in rows], "doc_id long, quality int"))
    step, mask = int(N._STEP), (1 << 64) - 1

    def bucket(x):
        return int(N.mix64(np.array([x & mask], np.uint64))[0]) % N.BUCKETS

    def slow(text):
        words = (text or "").encode().split()
        w = [xxhash.xxh64_intdigest(x) for x in words]
        kind = lambda c: "A" if c.isascii() and c.isupper() else "9" if c.isascii() and c.isdigit() else "a" if not c.isascii() or c.islower() else c
        s = [xxhash.xxh64_intdigest(re.sub(r"(.)\1+", r"\1", "".join(map(kind, x.decode()))).encode(), seed=7) for x in words]
        two = [a * step + b for a, b in zip(s, s[1:])]
        grams = [*w, *(a * step + b + 5 for a, b in zip(w, w[1:])), *(x + 1 for x in s), *(x + 2 for x in two), *(a * step + c + 3 for a, c in zip(two, s[2:]))]
        grams += [101] * any(a == b for a, b in zip(words, words[1:])) + [102] * any(a == b == c for a, b, c in zip(words, words[1:], words[2:]))
        margin = sum(float(model.weights[x]) for x in {bucket(g) for g in grams}) + model.bias
        return 1 / (1 + math.exp(-min(max(model.slope * margin + model.shift, -35), 35)))

    for table in (docs, odd_documents):
        texts = [r.text for r in table.orderBy("doc_id", "text").collect()]
        got = [r.score for r in N.scored(table.select("doc_id", "text").orderBy("doc_id", "text"), model).collect()]
        assert len(got) == len(texts) and all(abs(a - slow(t)) < 1e-9 for a, t in zip(got, texts))


def test_sample_of_features_is_bounded(spark):
    rows = [(i, f"word{i} and more words {i % 7}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, quality int")
    assert {r.score for r in N.scored(docs, N.learned(docs, labels, sample_features=1)).collect()} == {0.5}
    assert len({r.score for r in N.scored(docs, N.learned(docs, labels, sample_features=300)).collect()}) > 1
