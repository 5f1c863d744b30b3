import random

from tidepool.llm import decontam as D


def edit(item, text):
    """Least edit distance of item to any part of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def noisy(rng, text, edits):
    t = list(text)
    for _ in range(edits):
        at = rng.randrange(len(t))
        kind = rng.randrange(3)
        t[at : at + (kind < 2)] = [] if kind == 0 else [rng.choice("abcdefgh ")]
    return "".join(t)


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(200):
        item = "".join(rng.choices("abc ", k=rng.randrange(1, 90)))
        text = noisy(rng, "".join(rng.choices("abc ", k=20)) + item, rng.randrange(6)) + "".join(rng.choices("abc ", k=20))
        k = rng.randrange(0, 12)
        hit = D.myers(item, text, k)
        assert (hit[0] if hit else None) == (edit(item, text) if edit(item, text) <= k else None)


def test_finds_what_brute_force_finds(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randrange(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 30)))) for i in range(25)]
    docs = []
    for d in range(60):
        base = [word() for _ in range(rng.randrange(0, 80))]
        if rng.random() < 0.6:
            base.insert(rng.randrange(len(base) + 1), noisy(rng, rng.choice(items)[1], rng.choice((0, 1, 3, 6, 12))).upper().replace(" ", "\n "))
        docs.append((d, " ".join(base)))
    docs += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1]), (None, items[1][1])]
    items += [(90, None), (91, ""), (92, items[3][1])]
    want = sorted(((d, i, e) for d, t in docs for i, x in items if D.normal(x) and D.normal(t) for e in [edit(D.normal(x), D.normal(t))] if e <= D.budget(len(D.normal(x)), 0.15)), key=repr)
    df, ib = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 900):
        assert sorted(((r.doc_id, r.item_id, r.distance) for r in D.leaks(df, ib, 0.15, chars).collect()), key=repr) == want
        left = D.without_leaks(df, ib, 0.15, chars).collect()
        assert sorted((r.doc_id for r in left), key=repr) == sorted((d for d, t in docs if not any(D.normal(t) and D.normal(x) and edit(D.normal(x), D.normal(t)) <= D.budget(len(D.normal(x)), 0.15) for _, x in items)), key=repr)
    assert D.leaks(df.limit(0), ib).count() == 0 and D.leaks(df, ib.limit(0)).count() == 0


def test_odd_rows(spark, odd_documents):
    items = spark.createDataFrame([(1, "sat on the mat and it was good"), (None, "a row without an id")], "item_id long, text string")
    assert sorted((r.doc_id for r in D.leaks(odd_documents, items).collect()), key=repr) == sorted([1, 1, 2, None], key=repr)
    assert D.without_leaks(odd_documents, items).columns == odd_documents.columns
