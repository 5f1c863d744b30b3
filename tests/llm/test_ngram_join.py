import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidepool.llm import ngram_join as N


def reference(rows, k, num, den):
    """(id, set size, component) by counting common shingles of all pairs."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in inverted[g])
        for g in s:
            inverted[g].append(i)
        for j, n in common.items():
            if den * n >= num * (len(s) + len(sets[j]) - n):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def corpus(seed, n=160):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.choice((0, 1, 1, 2, 3, 6))):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randrange(2)] = [rng.choice(vocabulary)]
            texts.append(" ".join(words))
        else:
            texts.append(" ".join(rng.choices(vocabulary, k=rng.choice((1, 2, 4, 9, 15, 24, 60, 200)))))
    return list(enumerate(texts))


@pytest.mark.parametrize(("k", "num", "den", "unit"), [(3, 90, 100, 10**6), (5, 80, 100, 10**6), (3, 90, 100, 300), (2, 70, 100, 200)])
def test_groups_equal_brute_force(spark, k, num, den, unit):
    rows = corpus(k + unit)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, N.jaccard_groups(docs, k, num, den, unit).collect()), key=repr)
    assert got == reference(rows, k, num, den)


def test_odd_rows(spark, odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert sorted(map(tuple, N.jaccard_groups(odd_documents, 3, 90, 100).collect()), key=repr) == reference(rows, 3, 90, 100)
    assert N.jaccard_groups(no_documents).count() == 0
    kept = N.one_of_each(odd_documents, 3, 90, 100)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([1, 3, 4, 5, None, None, 6, 7, 8], key=repr)


def test_queries_dealt_over_tasks(spark):
    """Units whose queries are dealt over tasks join what one task joins."""
    rows = corpus(4)
    sets = [(i, N.shingles(t.encode(), 2, N.WordHashes())) for i, t in rows]
    table = spark.createDataFrame([(i, h.tobytes()) for i, h in sets], "node long, elements binary")
    blocks = spark.createDataFrame([(i, i % 2, len(h)) for i, h in sets], "node long, root long, n_shingles long")

    def classes(work, unit):
        return sorted(map(tuple, N.components(N.links_of(table, blocks, 70, 100, unit, work), "a", "b").collect()))

    assert classes(10**9, 10**6) == classes(3000, 10**6) == classes(400, 900)


def test_components_salt_hubs(spark):
    """A node of many edges is joined in parts; the classes are the same."""
    edges = [(0, i) for i in range(1, 300)] + [(1000 + i, 1001 + i) for i in range(40)] + [(299, 2000)]
    table = spark.createDataFrame(edges, "a long, b long")
    want = sorted([(i, 0) for i in [*range(300), 2000]] + [(1000 + i, 1000) for i in range(41)])
    for hub in (10, 10**6):
        assert sorted(map(tuple, N.components(table, "a", "b", hub=hub).collect())) == want


def test_copies_are_salted(spark):
    """Rows of a node of many copies are joined in parts, with what a plain join gives; rows without a node stay."""
    rows = [(i, 7 if i % 3 else i, i % 5) for i in range(200)] + [(None, 7, 1), (None, None, 0), (5, None, 0), (5, 7, 2), (5, 7, 2)]
    table = spark.createDataFrame(rows, "doc_id long, node long, n_shingles long")
    named = table.filter("node is not null").groupBy("node").agg(N.F.min("doc_id").alias("least"))
    want = sorted(map(tuple, table.join(named, "node", "left").select(*table.columns, "least").collect()), key=repr)
    for copies in (1, 10, None):
        got = N._of_node(table, named, len(rows), copies)
        assert sorted(map(tuple, got.select(*table.columns, "least").collect()), key=repr) == want


def threshold_corpus(seed, num, den):
    """Documents of 150 to 2000 words, and copies with so many words changed at one end that they link just or just not."""
    rng, texts = random.Random(seed), []
    passage = [f"p{i}" for i in range(120)]
    for n in (150, 151, 320, 700, 2000):
        words = [f"{n}_{i}" for i in range(n)] + passage
        texts.append(" ".join(words))
        d = (len(words) - 2) * (den - num) // (den + num)
        for more in (-2, -1, 0, 1, 2):
            at = d + more
            texts.append(" ".join([f"x{rng.random()}" for _ in range(at)] + words[at:]))
            texts.append(" ".join(words[at * (den + num) // den :]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("num", "chunk"), [(90, 900), (80, 10**6)])
def test_links_at_the_threshold(spark, num, chunk):
    rows = threshold_corpus(num, num, 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, N.jaccard_groups(docs, 3, num, 100, chunk=chunk).collect()), key=repr)
    assert got == reference(rows, 3, num, 100)


def test_prefixes_lose_no_pair():
    """Linked sets share enough of the elements looked at, and a key, whatever the order and the counts."""
    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (80, 100)):
        p = N.Prefixes(num, den)
        for n in [*range(1, 60), 100, 500, 2000]:
            for _ in range(6):
                a = rng.integers(1, 2**63, n, dtype=np.uint64)
                common = p.low(n)
                while den * common < num * (n + n - common):
                    common += 1
                b = np.concatenate([a[:common], rng.integers(1, 2**63, n - common, dtype=np.uint64)])
                for other in (b, a[: p.low(n)]):
                    x, y = np.sort(a), np.sort(other)
                    both = np.intersect1d(x[: p.looked_at(len(x))], y[: p.looked_at(len(y))])
                    assert len(both) >= max(1, p.low(min(len(x), len(y))) * p.extra // 100)
                    count = dict(zip(np.union1d(x, y).tolist(), rng.integers(1, 4, 2 * n).tolist()))
                    counts = [np.array([max(count[e], 1 + (e in x and e in y)) for e in s.tolist()]) for s in (x, y)]
                    assert set(p.block_keys(x, counts[0]).tolist()) & set(p.block_keys(y, counts[1]).tolist()), (n, len(other))


def test_copies_over_tasks_are_one_node(spark):
    """Copies in several tasks and chunks neither count as others nor hide them."""
    rows = [(i, t) for i, t in enumerate([t for _, t in corpus(9, 60)] * 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, N.jaccard_groups(docs, 3, 90, 100, chunk=50).collect()), key=repr)
    assert got == reference(rows, 3, 90, 100)


def test_one_of_each_keeps_other_texts_of_an_id(spark):
    """Rows of one id with different texts are different documents; equal ones stay once; a copy goes whatever its id."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (1, b), (2, a), (2, c), (3, b), (3, b), (4, c), (5, c), (6, " "), (6, " ")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in N.one_of_each(docs).collect()) == [(1, "a"), (1, "b"), (2, "c"), (6, " "), (6, " ")]


def test_search_equals_brute_force():
    rng = random.Random(5)
    sets = [np.unique(np.array(rng.choices(range(1, 60), k=rng.randrange(5, 40)), np.uint64)) for _ in range(60)]

    class All:
        def __call__(self, x):
            return False

        def linked(self, a, b):
            pass

    search = N.Searcher(sets, 60, 100)
    for q, s in enumerate(sets):
        want = [i for i, o in enumerate(sets) if i != q and 100 * len(np.intersect1d(s, o)) >= 60 * len(np.union1d(s, o))]
        assert sorted(search.search(q, All())) == want
