import random
from collections import Counter

from tidepool.llm import ring as R


def one_by_one(counts, shards, slack, vnodes, cells):
    """Rows in order of arrival, each walking clockwise until a shard has room."""
    nodes = R.virtual_nodes(shards, vnodes, cells)
    room = R.capacities(sum(counts.values()), shards, slack)
    filled, out = [0] * shards, {}
    for cell in sorted(counts, key=lambda c: R._point("cell", c)):
        start = next((i for i, n in enumerate(nodes) if n[0] >= cell), 0)
        for rank in range(counts[cell]):
            for step in range(len(nodes)):
                shard = nodes[(start + step) % len(nodes)][2]
                if filled[shard] < room[shard]:
                    out[cell, rank] = shard, filled[shard]
                    filled[shard] += 1
                    break
    return out


def test_plan_equals_one_by_one():
    rng = random.Random(1)
    for slack in (0.0, 0.1):
        counts = {c: rng.choice((1, 1, 2, 9)) for c in rng.sample(range(500), 200)}
        plan = R.plan(counts, 7, slack, 5, 500)
        got = {(c, r): (s, base + r - lo) for c, lo, hi, s, base in plan for r in range(lo, hi)}
        assert got == one_by_one(counts, 7, slack, 5, 500)


def test_balance_and_movement(spark):
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('text ', id % 50) as text")
    rows = R.sharded(docs, 24, 0.0).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == 6000 and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(24))
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(n[s])) for s in n)
    a = {r.doc_id: r.shard for r in R.sharded(docs, 12, 0.25).collect()}
    b = {r.doc_id: r.shard for r in R.sharded(docs, 13, 0.25).collect()}
    assert sum(a[d] != b[d] for d in a) < 6000 * 0.25
    assert max(Counter(a.values()).values()) <= 6000 / 12 * 1.25 + 1


def test_odd_rows(spark, odd_documents, no_documents):
    rows = R.sharded(odd_documents, 4).collect()
    assert len(rows) == odd_documents.count() and len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id == 3} == {(8, 0)}
    assert R.sharded(no_documents, 4).count() == 0
