import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidepool.operators import clusters as C
from tidepool.operators import models as M
from tidepool.operators import sampling as S
from tidepool.operators import voice as V
from tidepool.plans import catalogue


def edges_of(rng, n, m):
    return sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})


def test_components_and_stars(spark):
    rng = random.Random(3)
    for n, m in ((30, 20), (40, 60)):
        edges = edges_of(rng, n, m)
        near = {i: {b for a, b in [*edges, *((b, a) for a, b in edges)] if a == i} for i in range(n)}
        nodes = spark.range(n).withColumnRenamed("id", "k")
        df = spark.createDataFrame(edges, "a long, b long")
        root = {}
        for i in range(n):
            seen, todo = {i}, [i]
            while todo:
                todo += [x for x in near[todo.pop()] if x not in seen and not seen.add(x)]
            root[i] = min(seen)
        assert {r.k: r.root for r in C.components(nodes, df, "k").collect()} == root
        free, star = set(range(n)), {}
        for i in sorted(range(n), key=lambda i: (-len(near[i]), i)):
            if i in free:
                for x in {i} | near[i] & free:
                    star[x] = i
                free -= {i} | near[i]
        assert {r.k: r.center for r in C.greedy_stars(nodes, df, "k").collect()} == star


def test_cosine_pairs_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [(i, "".join(rng.choices("abcd", k=rng.randrange(2, 14)))) for i in range(80)]
    vectors = C.gram_vectors(spark.createDataFrame(texts, "k long, t string"), "k", "t")
    got = {(r.a, r.b): r.cosine for r in C.cosine_pairs(vectors, "k", 0.6).collect()}
    table = {}
    for r in vectors.collect():
        table.setdefault(r.k, {})[r.gram] = r.w
    want = {(a, b): c for a in table for b in table if a < b for c in [sum(w * table[b].get(g, 0) for g, w in table[a].items())] if c >= 0.6}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-9 for p in got)


def test_things_and_layers(spark):
    rows = [("p", f"v{i % 3}", "Good line", "good line", 0.1 + i * 0.01) for i in range(4)] + [("p", "v1", "good line!", "good line", 0.9)]
    rows += [("p", f"v{i}", "stay", "stay", 0.5) for i in range(5)]
    df = spark.createDataFrame(rows, "pool string, video string, content string, norm string, percent double")
    members = spark.createDataFrame([("p", "good line", "a"), ("p", "stay", "b")], "pool string, norm string, cluster string")
    found = C.things(df, members, ["pool"])
    t = {r.cluster: r for r in found.collect()}
    assert t["a"].text == "Good line" and abs(t["a"].median - 0.12) < 1e-9 and t["a"].n_videos == 3 and abs(t["a"].local - 0.8) < 1e-9
    spans = spark.createDataFrame([("p", 0.4, 0.6)], "pool string, start double, end double")
    assert {r.cluster: r["mode"] for r in C.marked_mode(found, spans, ["pool"]).collect()} == {"a": "dialogue", "b": "topic"}
    assert {r.cluster: r.role for r in C.arranged(found, ["pool"]).collect()} == {"a": "chorus", "b": "place"}
    lines = df.join(members, ["pool", "norm"]).join(found.select("pool", "cluster", "text"), ["pool", "cluster"])
    assert [r.content for r in C.evidence(lines.filter("cluster = 'a'"), ["pool", "cluster"]).orderBy("place").collect()] == ["Good line", "good line!"]


def test_shared_pieces_equal_greedy_choice(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choices("甲乙丙丁", k=2)) + rng.choice(["人间正道是沧桑", "正道是沧桑啊", "风景这边独好", ""]) + rng.choice("戊己") for _ in range(40)]
    keys = ["独好"]
    overlaps = lambda p: any(k[i : i + 2] in p for k in keys for i in range(len(k) - 1))
    counts = {}
    for t in lines:
        for p in {t[i : i + n] for n in range(4, 9) for i in range(len(t) - n + 1)}:
            if not overlaps(p):
                counts[p] = counts.get(p, 0) + 1
    leads = lambda a, b: any(a.endswith(b[:k]) or b.endswith(a[:k]) for k in range(2, min(len(a), len(b))))
    kept = []
    for p, n in sorted(counts.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        if n >= 4 and not any(p in o and p != o and counts[o] >= n for o in counts) and not any(leads(p, k) for k, _ in kept):
            kept.append((p, n))
    df = spark.createDataFrame([(1, t, keys) for t in lines], "film long, norm string, matter array<string>")
    assert [(r.piece, r.n) for r in V.shared_pieces(df, ["film"]).orderBy("place").collect()] == kept[:3]


def test_reservoir_equals_one_by_one(spark):
    from tests.test_coding import fnv

    rng = random.Random(9)
    texts = [f"t{rng.randrange(500)}" for _ in range(600)]
    slots = {}
    for n, t in enumerate(texts, 1):
        if n <= 25:
            slots[n - 1] = t
        elif fnv(t) % n < 25:
            slots[fnv("slot:" + t) % 25] = t
    df = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "k int, ord int, text string")
    assert {r.slot: r.text for r in S.reservoir(df, "text", ["k"], ["ord"], 25).collect()} == slots


def test_models_learn(spark):
    rows = [(f"{w} {i}", [w]) for i in range(40) for w in ("alpha", "omega")]
    train = spark.createDataFrame(rows, "text string, labels array<string>")
    weights = M.fit(train, ["alpha", "omega"], epochs=6)
    own = M.scores(train, weights).join(train, "text").selectExpr("text", "code", "p", "cast(array_contains(labels, code) as int) as y")
    said = M.predicted(own, M.grid_thresholds(own)).join(train, "text")
    assert said.filter("predicted = labels").count() == len(rows)
    result = M.agreement(train, train.limit(0), ["alpha", "omega"])
    assert result[0].first().exact > 0.9 and M.agreement(train.limit(5), train.limit(0), ["alpha"]) is None


def test_bootstrap_takes_all_draws(spark):
    from tests.test_coding import fnv

    d = "/root/testdata/sf0.001"
    rows = catalogue.events(spark, d).select("video", "grp", "code").collect()
    videos = sorted({r.video for r in rows})
    lifts = {}
    for n in range(1000):
        times = Counter(videos[fnv(f"{n}:{k}") % len(videos)] for k in range(len(videos)))
        hits, size, of_code = Counter(), Counter(), Counter()
        for r in rows:
            m = times[r.video]
            hits[r.grp, r.code] += m
            size[r.grp] += m
            of_code[r.code] += m
        for (g, c), h in hits.items():
            if h:
                lifts.setdefault((g, c), []).append(h / size[g] / (of_code[c] / size.total()))
    got = {(r.grp, r.code): (r.low, r.high, r.above_one) for r in catalogue.bootstrap_intervals(spark, d).collect()}
    assert got.keys() == lifts.keys()
    for k, v in lifts.items():
        want = (*np.percentile(v, [2.5, 97.5]), np.mean(np.array(v) > 1))
        assert np.allclose(got[k], want, atol=2e-6)


def test_models_take_every_row_in_ten_epochs(spark):
    """More rows than training once took, and weights of a plain loop over rows in memory."""
    many = spark.range(50_001).selectExpr("cast(id as string) as text", "array(if(id % 3 = 0, 'a', 'b')) as labels")
    assert M.fit(many, ["a"], epochs=1).filter("bucket = -1").count() == 1
    rows = [(f"{w} {i}", [w]) for i in range(30) for w in ("alpha", "omega", "other")]
    train = spark.createDataFrame(rows, "text string, labels array<string>")
    data = sorted((r.text, r.buckets, r.labels) for r in M.featured(train).collect())
    got = {(r.code, r.bucket): r.w for r in M.fit(train, ["alpha", "omega"]).collect()}
    for code in ("alpha", "omega"):
        w, bias, shuffle = np.zeros(1 << 15), 0.0, np.random.default_rng(0)
        for _ in range(10):
            for i in shuffle.permutation(len(data)):
                y = float(code in data[i][2])
                step = 0.15 * (y - 1 / (1 + np.exp(-np.clip(w[data[i][1]].sum() + bias, -20, 20)))) * (2.0 if y else 1.0)
                w[data[i][1]] += step
                bias += step
            w *= 1 - 1e-4
        want = {(code, int(k)): w[k] for k in np.flatnonzero(w)} | {(code, -1): bias}
        mine = {k: v for k, v in got.items() if k[0] == code}
        assert mine.keys() == want.keys() and all(abs(mine[k] - want[k]) < 1e-9 for k in want)


def test_char_model_trains_as_the_operator(spark):
    d = "/root/testdata/sf0.001"
    c = catalogue.table(spark, d, "conversations").filter("length(text) > 0").selectExpr("text", "array(role) as labels")
    train = S.merged_labels(c).withColumn("part", S.hash_split(F.col("text"))).filter("part = 'train'")
    want = M.scores(c, M.fit(train, ["user", "assistant", "system"], epochs=10)).select(F.md5("text").alias("text_md5"), "code", F.round("p", 6).alias("p"))
    assert sorted(map(tuple, catalogue.char_model(spark, d).collect())) == sorted(map(tuple, want.collect()))


def test_dense_windows_take_stars_and_windows_are_joined(spark):
    """A chain in a dense window splits into stars, in a sparse one it is one cluster; an edge between windows joins."""
    phrases = spark.createDataFrame([(f"d{i}", "p", 0) for i in range(5)] + [(f"s{i}", "p", 1) for i in range(5)] + [("x", "p", 2)], "key string, pool string, window int")
    chain = [(f"{w}{i}", f"{w}{i + 1}") for w in "ds" for i in range(4)]
    dense = spark.createDataFrame([("p", 0, 9)], "pool string, bin int, n long")

    def clusters(edges):
        out = {}
        for r in C.windowed(phrases, spark.createDataFrame(edges, "a string, b string"), dense).collect():
            out.setdefault(r.cluster, set()).add(r.key)
        return sorted(map(sorted, out.values()))

    assert clusters(chain) == [["d0", "d1", "d2"], ["d3", "d4"], ["s0", "s1", "s2", "s3", "s4"], ["x"]]
    assert clusters([*chain, ("d4", "s0"), ("s4", "x")]) == [["d0", "d1", "d2"], ["d3", "d4", "s0", "s1", "s2", "s3", "s4", "x"]]
