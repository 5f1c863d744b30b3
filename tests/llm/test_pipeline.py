import corpus_pipeline as P
import public_tokenizers

from tidepool.llm import decontam, nbsvm, ngram_join

D = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark):
    d = D
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = P.quality(spark, docs, d)
    assert kept.columns == docs.columns
    scores = nbsvm.scored(docs, nbsvm.learned(docs, spark.read.parquet(f"{d}/labels.parquet")))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in scores.filter("predicted = 1").collect())
    single = P.near_duplicates(spark, kept, d)
    groups = ngram_join.jaccard_groups(kept, 5, 80, 100)
    assert sorted(r.doc_id for r in single.collect()) == sorted({r.component_id for r in groups.collect()})
    clean = P.decontamination(spark, single, d)
    bad = decontam.leaks(single, spark.read.parquet(f"{d}/benchmark.parquet"))
    assert clean.count() == single.count() - bad.select("doc_id").distinct().count() < single.count()
    assert [n for n, _ in P.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "best-fit packing"]
    packed = P.run(spark, d)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in clean.collect()}


def test_odd_and_empty_tables(spark, odd_documents, no_documents, tmp_path):
    """Nulls, empty and very long texts, repeats and a clashing column pass; an empty table gives no rows."""
    labels = spark.createDataFrame([(1, 1), (2, 1), (7, 1), (8, 1), (6, 0), (None, 0), (3, None)], "doc_id long, quality int")
    items = spark.createDataFrame([(1, "a benchmark item that no document holds at all"), (2, None), (3, "")], "item_id long, text string")
    for name, docs in (("odd", odd_documents), ("none", no_documents)):
        folder = tmp_path / name
        for table, df in (("documents", docs), ("labels", labels), ("benchmark", items)):
            df.write.parquet(str(folder / f"{table}.parquet"))
        kept = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in P.STAGES[:-1]:
            kept = stage(spark, kept, str(folder))
            assert kept.columns == docs.columns
        out = P.run(spark, str(folder)).collect()
        assert sorted({r.doc_id for r in out}, key=repr) == sorted({r.doc_id for r in kept.collect()}, key=repr)
        assert (len(out) > 0) == (name == "odd")


def test_run_equals_slow_stages(spark):
    """The rows of run() from each stage done slowly: scores one by one, all pairs of sets, all items in all texts, tokens by the library."""
    import zlib

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{D}/documents.parquet")
    labels, items = spark.read.parquet(f"{D}/labels.parquet"), spark.read.parquet(f"{D}/benchmark.parquet").collect()
    model, features = nbsvm.learned(docs, labels), nbsvm.Features()
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if model.score(features((r.text or "").encode())) >= nbsvm.THRESHOLD)
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := t.encode().lower().split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for j, s in enumerate(sets):
        for i in range(j):
            common = len(s & sets[i])
            if common and 100 * common >= 80 * (len(s) + len(sets[i]) - common):
                old, new = group[j], group[i]
                group = [new if g == old else g for g in group]
    rows = [r for n, r in enumerate(rows) if group.index(group[n]) == n]

    def holds(text, item):
        """Whether a passage of text is within the item's budget: the last row of the table of edit distances."""
        k, row = int(len(item) * decontam.RATE), list(range(len(item) + 1))
        for c in text:
            new = [0]
            for j, x in enumerate(item, 1):
                new.append(min(row[j - 1] + (x != c), row[j] + 1, new[-1] + 1))
            row = new
            if row[-1] <= k:
                return True
        return False

    def likely(text, item):
        """A passage within the budget shares a run of n // (k + 1) characters; only texts with one are tried."""
        k = int(len(item) * decontam.RATE)
        m = len(item) // (k + 1)
        return any(item[i : i + m] in text for i in range(len(item) - m + 1))

    wanted = [x for i in items if (x := decontam.normal(i.text))]
    rows = [(d, t) for d, t in rows if not any(likely(n, x) and holds(n, x) for n in [decontam.normal(t)] for x in wanted)]
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = [*tokens.encode(t, add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > first else [0, len(ids)]
        want += [(d, n, a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b]))) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = P.run(spark, D).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    bins = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024 and len(bins) <= sum(w[3] for w in want) / 1024 * 1.03 + 2
