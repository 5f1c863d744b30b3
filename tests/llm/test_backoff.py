import math
from collections import Counter

import pytest

from tidepool.llm import backoff as B


def reference(rows, alpha, order):
    """Scores by direct counts of n-grams as tuples of words."""
    words = [(d, (t or "").encode().lower().split()) for d, t in rows]
    grams = lambda w, n: [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
    whole = Counter(g for _, w in words for n in range(1, order + 1) for g in grams(w, n))
    total, out = sum(len(w) for _, w in words), []
    for d, w in words:
        mine = Counter(g for n in range(1, order + 1) for g in grams(w, n))
        c = lambda g: whole[g] - mine[g]
        s = 0.0
        for i in range(len(w)):
            most = min(order, i + 1)
            n = next((n for n in range(most, 1, -1) if c(tuple(w[i - n + 1 : i + 1]))), 1)
            top = tuple(w[i - n + 1 : i + 1])
            s += math.log(alpha) * (most - n) + math.log(max(c(top), 1)) - math.log(c(top[:-1]) if n > 1 else max(total - len(w), 1))
        out.append((repr(d), len(w), s))
    return sorted(out)


def rows_of(odd_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()] + [(100 + i, f"the cat sat on {i % 3} the dog sat on a mat the cat") for i in range(20)]
    return rows + [(200 + i, " ".join(f"w{j * j % (7 + i)}" for j in range(60))) for i in range(12)] + [(300, "the"), (301, "the cat")]


@pytest.mark.parametrize(("order", "flush", "bucket"), [(1, 10**6, 10**6), (2, 50, 700), (3, 10**6, 10**6), (3, 40, 300), (4, 200, 5000)])
def test_scores_equal_a_direct_count(spark, odd_documents, order, flush, bucket):
    rows = rows_of(odd_documents)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((repr(r.doc_id), r.n_words, r.log_score) for r in B.backoff_scores(docs, order=order, flush_words=flush, bucket_bytes=bucket).collect())
    want = reference(rows, B.ALPHA, order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-9 * max(1, abs(w[2])) for g, w in zip(got, want, strict=True))


def test_scores_do_not_depend_on_the_layout(spark, odd_documents):
    """To the last bit, however rows, flushes and buckets are dealt."""
    docs = spark.createDataFrame(rows_of(odd_documents), "doc_id long, text string")
    runs = [(1, 10**6, 10**6, 1), (4, 100, 900, 2), (2, 33, 10**5, 3)]
    got = [sorted((repr(r.doc_id), r.n_words, r.log_score) for r in B.backoff_scores(docs.repartition(p), flush_words=f, bucket_bytes=b, passes=n).collect()) for p, f, b, n in runs]
    assert got[0] == got[1] == got[2]


def test_empty(spark, no_documents):
    assert B.backoff_scores(no_documents).count() == 0
