"""N-gram Jaccard join: set-similarity groups of documents by T-occurrence search.

1. Every text becomes its set of distinct k-word shingles (64-bit hashes). Equal sets fold into one node.
2. A set of n elements links only with sets that hold at least low(n) = ceil(n num/den) of them. Under one order of all shingles,
   here by hash, the first n - low(n) + e(n) elements of linked sets have at least min(e) elements in common, where e(n) is EXTRA
   percent of n, at least 1. Sets with fewer elements there that any other set has there too link with nothing; most texts end here.
   One exchange of that share of the shingles finds them.
3. Of the others, all elements are counted, and the order is by that count, rarest first. Linked sets share one of their first
   n - low(n) + 1 elements. As these are the rarest, passages that many documents share are not among them, unless they make up
   the documents. Sets that share such an element, and are of sizes that may link, form blocks (connected components over one
   star an element, never all pairs of an element).
4. Each block is searched by T-occurrence with DivideSkip: inverted lists of the block; the shortest ones are heap-merged,
   the longest ones only probed by binary search; sets that reach the required overlap are links.
5. Blocks of too many shingles are cut into units that share a pivot; whatever stays outside a block's main component is
   then searched against all units.

No step leaves out a link at any size, but where 64-bit hashes of different shingles or sets are equal. Elements that many sets
have are counted within chunks of sets before they are shuffled, so an element gives a chunk one row, however many sets have it.

Definitions: A-Z are lower-cased, words are runs of anything but space and U+0009..U+000D. A text of fewer than k words has
its whole sequence as its only shingle. Null, empty and blank texts have empty sets and link with nothing. Rows with equal
ids are separate rows of the same result; a null id never becomes a component's name unless all ids of it are null. Sizes that
tie and repeated texts need no rule. Columns other than the id and the text are ignored. An empty table gives an empty result.
Texts are never cut: a task holds one text, its shingles (8 bytes a word) and a chunk of others at a time.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidepool.llm.common import WordHashes, components, forget, lean, mix64, small_batches, written

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEVEL = np.uint64(0xC2B2AE3D27D4EB4F)
#: Percent of a set's elements that are looked at in step 2 beyond what one common element needs.
EXTRA = 10
#: Elements that a task gathers as one chunk before it hands them on.
CHUNK = 500_000
#: Shingles that one search unit may hold (16 bytes each): about 16 MB in a worker.
UNIT_SHINGLES = 1_000_000
#: Sets times shingles that one task of a unit may search; beyond that, its queries are dealt over several tasks.
UNIT_WORK = 200_000_000
#: Shingles of units for each task of the search.
TASK_SHINGLES = 250_000
#: DivideSkip's weight of a merged item against a probe: the smaller, the more lists are probed.
MU = 0.001
#: Bits of the filter that picks the texts whose sets are needed. Fixed (2 MB); when full, more sets are shuffled, at most all of them once.
FILTER_BITS = 1 << 24


def shingles(data: bytes | None, k: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    found = data.lower().split() if data else []
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), seed=len(found))], np.uint64)
    w = np.frombuffer(array("Q", map(words.__getitem__, found)), np.uint64)
    n = len(w) - k + 1
    h = w[:n].copy()
    for j in range(1, k):
        h *= _STEP
        h += w[j : j + n]
    return np.unique(mix64(h))


def node_of(h: np.ndarray) -> int:
    """A set's 64-bit name, as a signed number."""
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(h.tobytes()))))


class Prefixes:
    """How many of a set's first elements linked sets share under the threshold num/den; see steps 2 and 3 above."""

    def __init__(self, num: int, den: int, extra: int = EXTRA, largest: int = 1 << 34):
        self.num, self.den, self.extra = num, den, min(extra, 100 * num // den)
        self.upper = [1]  # of classes of sizes: sets that link are of one class or of two that follow each other
        while self.upper[-1] < largest:
            self.upper.append(max(self.upper[-1] + 1, self.upper[-1] * den // num))

    def low(self, n: int) -> int:
        """The least overlap, and the least size, of a set that links with one of n elements."""
        return -(-self.num * n // self.den)

    def looked_at(self, n: int) -> int:
        return n - self.low(n) + max(1, n * self.extra // 100)

    def least_shared(self) -> str:
        """SQL of how many of the elements looked at another set must have, by n_shingles: e of the smallest set that may link."""
        return f"greatest(1L, (({self.num} * n_shingles + {self.den} - 1) div {self.den}) * {self.extra} div 100)"

    def block_keys(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Keys of a set whose elements occur in `counts` sets: the first elements that others have too, once for each class of
        sizes that it may link with. None if too few elements are shared."""
        n, low = len(h), self.low(len(h))
        shared = np.flatnonzero(counts > 1)
        if len(shared) < low:
            return np.empty(0, np.uint64)
        first = shared[np.lexsort((h[shared], counts[shared]))[: len(shared) - low + 1]]  # the n - len(shared) others come before these
        own = bisect_left(self.upper, n)
        return np.concatenate([mix64(h[first] + np.uint64(level * int(_LEVEL) & 0xFFFFFFFFFFFFFFFF)) for level in (own, own + 1)])


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.binary()).to_pylist()


def _lists(values: np.ndarray, row: np.ndarray, rows: int) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]), pa.int32()), pa.array(values.view(np.int64)))


def _nodes(k: int, prefixes: Prefixes, chunk: int):
    """Rows of nodes with the elements looked at in step 2, those of copies within a task only once (`known` is null for the others).

    Elements that several sets of a chunk have are `known` to be shared; one row carries such an element, marked by its last bit.
    """

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        ids, sizes, names, parts = zip(*rows, strict=True)
        first = np.array([p is not None for p in parts])
        parts = [np.empty(0, np.uint64) if p is None else p for p in parts]
        flat, row = np.concatenate(parts), np.repeat(np.arange(len(rows)), [len(p) for p in parts])
        _, at, inverse, counts = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        shared = counts[inverse] > 1
        stays = ~shared
        stays[at] = True
        marked = flat[stays] & np.uint64(0xFFFFFFFFFFFFFFFE) | shared[stays]
        known = np.bincount(row, weights=shared, minlength=len(rows)).astype(np.int64)
        columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(known, mask=~first), _lists(marked, row[stays], len(rows))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "node", "known", "elements"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, rows, held = WordHashes(), set(), [], 0
        for b in batches:
            for doc, text in zip(b.column(b.schema.get_field_index("doc_id")).to_pylist(), _texts(b), strict=True):
                h = shingles(text, k, words)
                node = node_of(h) if len(h) else None
                part = None
                if node is not None and node not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(node)
                    part = h[: prefixes.looked_at(len(h))].copy()
                    held += len(part)
                rows.append((doc, len(h), node, part))
                if held >= chunk or len(rows) >= chunk // 10:
                    yield flush(rows)
                    rows, held = [], 0
        if rows:
            yield flush(rows)

    return run


def _sets(k: int, bits: bytes):
    """The sets of the texts whose id the filter lets through, each once a task."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, wanted = WordHashes(), set(), np.frombuffer(bits, np.uint64)
        size = len(wanted) * 64
        for b in batches:
            nodes, sets = [], []
            ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            texts = b.column(b.schema.get_field_index("text")).cast(pa.binary())
            for i, doc in enumerate(ids):
                if doc is not None and not int(wanted[doc % size >> 6]) >> (doc % size & 63) & 1:
                    continue
                h = shingles(texts[i].as_py(), k, words)
                if not len(h) or (node := node_of(h)) in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(node)
                nodes.append(node)
                sets.append(h.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "elements"])

    return run


def _filter_bits(ids: DataFrame) -> bytes:
    """A bit for each doc_id modulo FILTER_BITS: at most FILTER_BITS / 64 numbers come to the driver. The join that follows is exact."""
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    found = _bits(ids).toArrow()
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out.tobytes()


def _place() -> tuple[Column, Column]:
    """The word of 64 bits that doc_id falls into, and its bit there."""
    return F.expr(f"shiftright(pmod(doc_id, {FILTER_BITS}), 6)"), F.expr(f"shiftleft(1L, cast(pmod(doc_id, {FILTER_BITS}) & 63 as int))")


def _bits(ids: DataFrame) -> DataFrame:
    """(word, bits): FILTER_BITS / 64 rows at most."""
    word, bit = _place()
    return ids.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def may_link(nodes: DataFrame, prefixes: Prefixes) -> DataFrame:
    """(node, first_id, n_shingles) of the nodes that step 2 leaves. Each copy that gave elements is credited the same shared ones."""
    names = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n_shingles"), F.sum("known").alias("known"), F.count("known").alias("copies"))
    each = nodes.select("node", F.explode("elements").alias("e")).select(F.col("e").bitwiseOR(F.lit(1)).alias("element"), F.when(F.col("e").bitwiseAND(F.lit(1)) == 0, F.col("node")).alias("node"))
    w = Window.partitionBy("element")
    others = (F.min("node").over(w) != F.max("node").over(w)) | (F.count("node").over(w) < F.count("*").over(w))
    credits = each.withColumn("others", others).filter("others and node is not null").groupBy("node").agg(F.count("*").alias("credit"))
    enough = F.col("known") + F.coalesce("credit", F.lit(0)) >= F.expr(prefixes.least_shared()) * F.col("copies")
    return names.join(credits, "node", "left").filter(enough).select("node", "first_id", "n_shingles")


def _chunked(chunk: int):
    """Rows (chunk, node, elements): as many sets in a row as hold `chunk` elements, named by the first of them."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, held = None, 0
        for b in batches:
            names = []
            for node, elements in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if name is None or held >= chunk:
                    name, held = node, 0
                held += len(elements.as_buffer()) // 8
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), b.column(0), b.column(1)], ["chunk", "node", "elements"])

    return run


def _dealt(buckets: int):
    """The distinct elements of a chunk with the number of its sets that have them, as blocks of columns, one a bucket."""

    def flush(chunk: int, sets: list[bytes]) -> pa.RecordBatch:
        each, counts = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_counts=True)
        bucket = (mix64(each) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order)).tolist()
        parts = [order[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        columns = [pa.array([bucket[p[0]] for p in parts], pa.int64()), pa.array([chunk] * len(parts), pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([each[p].tobytes() for p in parts], pa.binary()), pa.array([counts[p].astype(np.uint32).tobytes() for p in parts], pa.binary())], ["bucket", "chunk", "keys", "counts"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sets = None, []
        for b in batches:
            for name, elements in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name != chunk and sets:
                    yield flush(chunk, sets)
                    sets = []
                chunk = name
                sets.append(elements)
        if sets:
            yield flush(chunk, sets)

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows that have the same first column."""
    rows: list[dict] = []
    for b in batches:
        key = b.schema.names[0]
        for r in b.to_pylist():
            if rows and rows[-1][key] != r[key]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket: each chunk's elements that more than one set has, with the number of sets."""
    for rows in _runs(batches):
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in rows])
        _, inverse = np.unique(keys, return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in rows]))[inverse].astype(np.int64)
        out, start = [], 0
        for r in rows:
            stop = start + len(r["keys"]) // 8
            more = np.flatnonzero(counts[start:stop] > 1) + start
            if len(more):
                out.append((r["chunk"], keys[more].tobytes(), counts[more].tobytes()))
            start = stop
        yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["chunk", "keys", "counts"])


def _block_keys(prefixes: Prefixes):
    """Chunks of sets with the counts of their elements, sorted by chunk. Rows (key, node, null), one a chunk and key, and
    (null, node, first): sets of a chunk that have a key in common with its first one."""

    def keyed(rows: list[dict]) -> pa.RecordBatch:
        tables = [r for r in rows if r["keys"] is not None]
        each = np.concatenate([np.empty(0, np.uint64), *(np.frombuffer(r["keys"], np.uint64) for r in tables)])
        counts = np.concatenate([np.empty(0, np.int64), *(np.frombuffer(r["counts"], np.int64) for r in tables)])
        order = np.argsort(each)
        each, counts = np.append(each[order], np.uint64(0)), np.append(counts[order], 1)
        nodes, parts = [], []
        for r in rows:
            if r["elements"] is not None:
                h = np.frombuffer(r["elements"], np.uint64)
                at = np.searchsorted(each[:-1], h)
                nodes.append(r["node"])
                parts.append(prefixes.block_keys(h, np.where(each[at] == h, counts[at], 1)))
        keys = np.concatenate([np.empty(0, np.uint64), *parts])
        owner = np.repeat(np.array(nodes, np.int64), [len(p) for p in parts])
        names, at, inverse = np.unique(keys, return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([owner, owner[at][inverse]], 1)[owner != owner[at][inverse]], axis=0)
        none = np.zeros(len(pairs), np.int64)
        key = pa.array(np.concatenate([names.view(np.int64), none]), mask=np.arange(len(names) + len(pairs)) >= len(names))
        first = pa.array(np.concatenate([np.zeros(len(names), np.int64), pairs[:, 1]]), mask=np.arange(len(names) + len(pairs)) < len(names))
        return pa.RecordBatch.from_arrays([key, pa.array(np.concatenate([owner[at], pairs[:, 0]])), first], ["key", "node", "first"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            yield keyed(rows)

    return run


def block_edges(sets: DataFrame, prefixes: Prefixes, chunk: int) -> DataFrame:
    """Edges (node, first) of the blocks of step 3. sets: chunk, node, elements, written."""
    total = sets.agg(F.coalesce(F.sum(F.octet_length("elements")), F.lit(0))).first()[0] // 8
    buckets = 1 + total // chunk
    dealt = sets.select("chunk", "elements").mapInArrow(_dealt(buckets), "bucket long, chunk long, keys binary, counts binary")
    counted = dealt.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_counted), "chunk long, keys binary, counts binary")
    both = sets.unionByName(counted, allowMissingColumns=True).repartition(buckets, "chunk").sortWithinPartitions("chunk")
    keyed = written(both.mapInArrow(_block_keys(prefixes), "key long, node long, first long"), "keys")
    stars = keyed.filter("key is not null").withColumn("first", F.min("node").over(Window.partitionBy("key"))).filter("node <> first")
    return keyed.filter("key is null").select("node", "first").unionByName(stars.select("node", "first"))


class Searcher:
    """T-occurrence search over the inverted lists of some sets."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.sizes = [len(s) for s in sets]
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")  # within a token, owners ascend
        self.tokens, self.owners = flat[order], owner[order]

    def needed(self, n: int, m: int) -> int:
        """The least overlap of sets of these sizes that link."""
        return -(-self.num * (n + m) // (self.num + self.den))

    def search(self, q: int, skip) -> list[int]:
        """All sets that link with set q, but those for which skip(set) holds when its turn comes."""
        s, n = self.sets[q], self.sizes[q]
        low, high = -(-self.num * n // self.den), self.den * n // self.num
        t = self.needed(n, max(low, 1))
        begin, end = np.searchsorted(self.tokens, s, "left"), np.searchsorted(self.tokens, s, "right")
        by_length = np.argsort(end - begin, kind="stable")
        # DivideSkip: the longest lists are set aside. Those few that remain decide which sets are looked at.
        longest = int(end[by_length[-1]] - begin[by_length[-1]])
        aside = min(t - 1, max(0, int(t / (MU * math.log2(longest + 1) + 1))))
        short = [self.owners[begin[i] : end[i]].tolist() for i in by_length[: n - aside]]
        long = [(int(begin[i]), int(end[i])) for i in by_length[n - aside :]]
        out, owners = [], self.owners
        previous, count = -1, 0
        for x in [*heapq.merge(*short), None] if short else []:  # None ends the last run
            if x == previous:
                count += 1
                continue
            if previous >= 0 and previous != q and count >= t - aside and low <= self.sizes[previous] <= high and not skip(previous):
                need, left = self.needed(n, self.sizes[previous]), len(long)
                for lo, hi in long:
                    if count >= need or count + left < need:
                        break
                    left -= 1
                    at = bisect_left(owners, previous, lo, hi)
                    count += at < hi and owners[at] == previous
                if count >= need:
                    out.append(previous)
                    skip.linked(q, previous)
            previous, count = x, 1
        return out


class _Union:
    """Union-find that knows the largest class; calling it with a set tells whether that is joined to the query."""

    def __init__(self, n: int):
        self.parent, self.weight, self.query = list(range(n)), [1] * n, 0
        self.main = 0

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def linked(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            if self.weight[a] < self.weight[b]:
                a, b = b, a
            self.parent[b] = a
            self.weight[a] += self.weight[b]
            if self.weight[a] >= self.weight[self.find(self.main)]:
                self.main = a

    def __call__(self, x: int) -> bool:
        return self.find(x) == self.find(self.query)


def block_links(sets: list[np.ndarray], num: int, den: int, queries: list[int] | None = None, pivot: int | None = None) -> list[tuple[int, int]]:
    """Links that connect what all links connect.

    Each set outside the largest class so far is searched against all sets, until none is left: of two linked sets in
    different classes one at least is outside the largest class, so no link between classes is missed, while copies of
    one text cost one search instead of one each. Of given queries, all are searched but those that a link chain joins to
    the pivot, which is searched first: tasks that share sets and pivot miss no link between classes either.
    """
    search, union, out = Searcher(sets, num, den), _Union(len(sets)), []
    if queries is not None:
        for q in ([] if pivot is None else [pivot]) + queries:
            if q == pivot or pivot is None or union.find(q) != union.find(pivot):
                union.query = q
                out += [(q, x) for x in search.search(q, union)]
        return out
    done: set[int] = set()
    before = -1
    while len(done) > before:  # once more, as another class may have become the largest
        before = len(done)
        for q in range(len(sets)):
            if q not in done and union.find(q) != union.find(union.main):
                done.add(q)
                union.query = q
                out += [(q, x) for x in search.search(q, union)]
    return out


#: Roles of a set in a unit: searched only, a query too, or the pivot of several tasks.
DATA, ASKS, PIVOT = 0, 1, 2


def _units(num: int, den: int):
    """Search runs of rows with the same unit; rows come sorted by it. A unit may span batches."""

    def flush(rows: list[tuple[int, bytes, int]]) -> list[tuple[int, int]]:
        names = [r[0] for r in rows]
        asked = [i for i, r in enumerate(rows) if r[2] == ASKS]
        pivot = next((i for i, r in enumerate(rows) if r[2] == PIVOT), None)
        found = block_links([np.frombuffer(r[1], np.uint64) for r in rows], num, den, None if len(asked) == len(rows) else asked, pivot)
        return [(names[a], names[b]) for a, b in found]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for b in batches:
            links = []
            for u, node, elements, role in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if u != unit:
                    links += flush(rows) if len(rows) > 1 else []
                    unit, rows = u, []
                rows.append((node, elements, role))
            yield _links(links)
        yield _links(flush(rows) if len(rows) > 1 else [])

    return run


def _links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])


def _searched(rows: DataFrame, num: int, den: int, shingles_held: int) -> DataFrame:
    """rows: unit, node, elements, role. Links (a, b) of nodes."""
    dealt = rows.select("unit", "node", "elements", "role").repartition(1 + shingles_held // TASK_SHINGLES, "unit").sortWithinPartitions("unit", "node")
    return dealt.mapInArrow(_units(num, den), "a long, b long")


def links_of(sets: DataFrame, blocks: DataFrame, num: int, den: int, unit_shingles: int = UNIT_SHINGLES, unit_work: int = UNIT_WORK) -> DataFrame:
    """Links within blocks. sets: node, elements; blocks: node, root, n_shingles."""
    size = blocks.groupBy("root").agg(F.sum("n_shingles").alias("weight"), F.count("*").alias("n"), F.min("node").alias("pivot"))
    size = size.withColumn("cuts", F.ceil(F.col("weight") / unit_shingles).cast("int")).withColumn("turns", F.ceil(F.col("n") / F.col("cuts") * F.col("weight") / F.col("cuts") / unit_work).cast("int"))
    own, mine = F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("turns")).cast("int")
    up_to = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    cut = F.when(F.col("node") == F.col("pivot"), up_to("cuts")).otherwise(F.array(own))  # the pivot is in every unit
    placed = written(blocks.join(size, "root").select("node", "root", "cuts", "turns", "n_shingles", (F.col("node") == F.col("pivot")).alias("pivot"), cut.alias("cut")), "placed")
    role = F.when(F.col("pivot") & (F.col("turns") > 1), PIVOT).when(F.col("turn") == mine, ASKS).otherwise(DATA)
    units = sets.join(placed, "node").withColumn("cut", F.explode("cut")).withColumn("turn", F.explode(up_to("turns"))).select(F.xxhash64("root", "cut", "turn").alias("unit"), "node", "elements", role.alias("role"))
    held = placed.agg(F.coalesce(F.sum(F.size("cut") * F.col("turns") * F.col("n_shingles")), F.lit(0))).first()[0]
    links = written(_searched(units, num, den, held), "links")
    if placed.filter("cuts > 1").isEmpty():
        return links
    # Classes that the units could not join: all that is outside a block's largest class against all of the block.
    named = placed.filter("cuts > 1").drop("cut", "turns", "pivot").join(components(links, "a", "b").withColumnRenamed("root", "class"), "node", "left").withColumn("class", F.coalesce("class", "node"))
    counts = named.groupBy("root", "class").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    main = counts.groupBy("root").agg(F.max_by("class", F.struct("n", "class")).alias("main"))
    rest = counts.join(main, "root").filter("class <> main").groupBy("root").agg(F.sum("shingles").alias("rest"))
    named = named.join(main, "root").join(rest, "root").withColumn("asks", F.ceil(F.col("rest") / unit_shingles).cast("int"))
    turn = F.pmod(F.xxhash64("node", F.lit(1)), F.col("asks")).cast("int")
    data = named.select("node", "root", own.alias("cut"), F.explode(up_to("asks")).alias("turn"), F.lit(DATA).alias("role"), "n_shingles")
    asking = named.filter("class <> main").select("node", "root", F.explode(up_to("cuts")).alias("cut"), turn.alias("turn"), F.lit(ASKS).alias("role"), "n_shingles")
    seats = written(data.unionByName(asking).groupBy("node", "root", "cut", "turn").agg(F.max("role").alias("role"), F.first("n_shingles").alias("n_shingles")), "seats")
    held = seats.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    again = sets.join(seats, "node").select(F.xxhash64("root", "cut", "turn").alias("unit"), "node", "elements", "role")
    return links.unionByName(written(_searched(again, num, den, held), "links"))


def _solved(docs: DataFrame, k: int, num: int, den: int, unit_shingles: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """nodes (doc_id, n_shingles, node) of all rows, and (node, component_id, least) of all nodes: the smallest id of the component,
    and the smallest of the nodes that have it. docs: doc_id, text."""
    prefixes = Prefixes(num, den)
    nodes = written(docs.mapInArrow(_nodes(k, prefixes, chunk), "doc_id long, n_shingles long, node long, known long, elements array<long>"), "nodes")
    left = written(may_link(nodes, prefixes), "left")
    bits = _filter_bits(left.select(F.col("first_id").alias("doc_id")).dropna())
    sets = docs.mapInArrow(_sets(k, bits), "node long, elements binary").join(left.select("node"), "node", "left_semi").dropDuplicates(["node"])
    sets = written(sets.mapInArrow(_chunked(chunk), "chunk long, node long, elements binary"), "sets")
    blocks = written(components(block_edges(sets, prefixes, chunk), "node", "first").join(left, "node"), "blocks")
    links = links_of(sets.drop("chunk"), blocks.select("node", "root", "n_shingles"), num, den, unit_shingles)
    classes = written(components(links, "a", "b").join(left, "node"), "classes")
    forget(left, sets, blocks)
    least = classes.groupBy("root").agg(F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "node"))).alias("least"))
    linked = classes.join(least, "root").select("node", F.col("least.first_id").alias("linked_id"), F.col("least.node").alias("least"))
    names = nodes.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"))
    named = names.join(linked, "node", "left").select("node", F.coalesce("linked_id", "first_id").alias("component_id"), F.coalesce("least", "node").alias("least"))
    return nodes.select("doc_id", "n_shingles", "node"), named


#: Rows of one node that one task may join, at least, and nodes of more than that, at most: the bound of a broadcast.
COPIES, MOST_COPIED = 256, 1_000_000


def _of_node(rows: DataFrame, named: DataFrame, count: int, copies: int | None = None) -> DataFrame:
    """rows (doc_id, node, ...) with what named (a row a node) says of their node. At most `count` rows in all.

    Copies of one text share a node: those of a node of more than `copies` rows are salted by their id over several tasks, and so
    are rows without a node, which meet nothing.
    """
    copies = copies or max(COPIES, -(-count // MOST_COPIED))
    many = F.broadcast(rows.filter("node is not null").groupBy("node").agg(F.ceil(F.count("*") / copies).cast("int").alias("_salts")).filter("_salts > 1"))  # fewer than count / copies rows
    salts = F.when(F.col("node").isNull(), 1 << 16).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = rows.join(many, "node", "left").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), salts).cast("int")).drop("_salts")
    dealt = named.join(many, "node", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return salted.join(dealt, ["node", "_salt"], "left").drop("_salt")


def _plain(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, unit_shingles: int = UNIT_SHINGLES, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents that links of similarity num/den or more connect."""
    small_batches(docs.sparkSession)
    nodes, named = _solved(_plain(docs, id_col, text_col), k, num, den, unit_shingles, chunk)
    return _of_node(nodes, named, nodes.count()).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One document of each group, with the smallest doc_id, and all documents without words.

    Rows are told apart by their id and their set: rows of one id that hold different texts are different documents. Rows of one id
    whose sets are equal stay once, with the first text. Documents without an id cannot be named by a group and stay.
    """
    small_batches(docs.sparkSession)
    nodes, named = _solved(_plain(docs), k, num, den, UNIT_SHINGLES, CHUNK)
    rows = nodes.filter("doc_id is not null and node is not null").groupBy("doc_id", "node").agg(F.count("*").alias("n"))
    rows = _of_node(rows, named, nodes.count())
    rows = written(rows.select("doc_id", "node", ((F.col("doc_id") == F.col("component_id")) & (F.col("node") == F.col("least"))).alias("stays"), (F.col("n") > 1).alias("again")), "rows")
    # Most texts stay. A filter over the ids that go, of a fixed size, tells those that surely stay; only the others are shuffled.
    gone = _bits(rows.filter("again or not stays").select("doc_id")).select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    word, bit = _place()
    marked = docs.withColumn("_word", word).join(F.broadcast(gone), "_word", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
    marked = marked.drop("_word", "_bits")
    at = docs.columns.index("text")

    def with_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for b in batches:
            sets = [shingles(t, k, words) for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([node_of(h) if len(h) else None for h in sets], pa.int64())], [*b.schema.names, "_node"])

    maybe = marked.filter("_maybe").drop("_maybe")
    maybe = maybe.mapInArrow(with_node, StructType([*maybe.schema.fields, StructField("_node", LongType())]))
    kept = rows.filter("stays").select(F.col("doc_id").alias("_id"), F.col("node").alias("_named"))
    found = maybe.join(kept, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_node") == F.col("_named")), "left_semi")
    first = Window.partitionBy("doc_id", "_node").orderBy(F.col("text"), *[F.col(c).cast("string").asc_nulls_last() for c in docs.columns])
    found = found.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1")
    return marked.filter("not _maybe").select(*docs.columns).unionByName(found.select(*docs.columns)).unionByName(maybe.filter("_node is null").select(*docs.columns))
