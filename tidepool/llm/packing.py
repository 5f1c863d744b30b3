"""Best-fit packing of token sequences by linear grouping (Fernandez de la Vega and Lueker).

1. Texts are tokenized once; documents longer than a sequence are cut, the first piece taking the remainder.
2. Large lengths are sorted and cut into groups of equal cardinality, each rounded up to its largest member. The few sizes that
   result are packed by configurations: a linear program over patterns (column generation, a knapsack each round), rounded
   down; what is left over is placed by best fit, decreasing.
3. Actual pieces take the places of the rounded ones, by rank.
4. Small pieces go best fit, decreasing, into the room that the actual pieces leave, then into new sequences.

The driver sees histograms only: numbers of pieces and of sequences by length or room, at most `capacity` rows each. It makes
a plan over ranks, whose size depends on the number of lengths and groups, not of pieces; ranks are counted in parallel.

A null or empty text is its end token alone. Equal rows are packed as separate pieces. Extra columns are ignored; an empty
table gives no rows. Texts of any length are tokenized whole, each within one task. Ties of length go by id, piece and checksum.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import lean, small_batches, written

CAPACITY, END_TOKEN, GROUPS, SMALL = 1024, 2, 96, 200
#: Pieces of one length that one task ranks.
RANK_ROWS = 50_000


@lru_cache(maxsize=2)
def encoder(path: str):
    """The vocabulary and merges of a tokenizers file, run by tiktoken, which yields the same ids at a quarter of the time."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    unbyte = {c: b for b, c in _byte_characters().items()}
    special = {x["content"]: x["id"] for x in spec["added_tokens"]}
    ranks = {bytes(unbyte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


@lru_cache(maxsize=2)
def whole_encoder(path: str):
    """The tokenizers library itself, for texts whose runs of white space are too long for the other one's patterns."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ids_of(text: str, path: str) -> list[int]:
    try:
        return encoder(path).encode(text, allowed_special="all")
    except ValueError:
        return whole_encoder(path).encode(text, add_special_tokens=False).ids


#: Fixed value: the words that byte-level BPE of this vocabulary is confined to.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_characters() -> dict[int, str]:
    """The printable characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in kept)}


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole sequences, but the first may be shorter."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def tokenized(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_TOKEN) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document."""
    names, types = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(np.array(ids_of(text or "", path), "<u4"), np.uint32(end)).astype("<u4")
                rows += [(doc, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(cuts(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


# --- the plan, over histograms ---


def _knapsack(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The best pattern of sizes within capacity: its value, and how often it has each size."""
    best, taken = np.zeros(capacity + 1), []
    for w, v in zip(sizes, values, strict=True):
        count = np.zeros(capacity + 1, np.int32)
        if v > 0:
            start = best.copy()
            for m in range(1, capacity // w + 1):
                moved = np.full(capacity + 1, -1.0)
                moved[m * w :] = start[: capacity + 1 - m * w] + m * v
                better = moved > best + 1e-12
                best = np.where(better, moved, best)
                count[better] = m
        taken.append(count)
    room, pattern = capacity, [0] * len(sizes)
    for g in range(len(sizes) - 1, -1, -1):
        pattern[g] = int(taken[g][room])
        room -= pattern[g] * sizes[g]
    return float(best[capacity]), pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and how often to use each, in whole numbers that pass no demand: the linear optimum, rounded down."""
    k = len(sizes)
    columns = [[capacity // w if i == j else 0 for j in range(k)] for i, w in enumerate(sizes)]
    basis = np.array(columns, float).T
    d = np.array(demand, float)
    x = np.linalg.solve(basis, d)
    for _ in range(40 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, pattern = _knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, np.array(pattern, float))
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        x = x - step * ratio[out]
        x[out] = ratio[out]
        basis[:, out] = pattern
        columns[out] = pattern
        x = np.maximum(x, 0)
    left, used = list(demand), []
    for pattern, times in sorted(zip(columns, x, strict=True), key=lambda p: -p[1]):
        times = min([int(times + 1e-6), *(left[g] // a for g, a in enumerate(pattern) if a)])
        if times > 0:
            used.append((pattern, times))
            left = [n - a * times for n, a in zip(left, pattern, strict=True)]
    return used


def large_plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """For large lengths: rows (length, first rank, end rank, first sequence, pieces a sequence), and the number of sequences.

    The piece of a length with rank r in a row's interval goes to the sequence `first + (r - first rank) // pieces`.
    """
    out, sequences = [], 0
    if full := counts.get(capacity, 0):
        out.append((capacity, 0, full, 0, 1))
        sequences = full
    lengths = sorted((n for n in counts if n < capacity), reverse=True)
    total = sum(counts[n] for n in lengths)
    if not total:
        return out, sequences
    starts, at = [], 0  # of each length, among the ranks of all lengths
    for n in lengths:
        starts.append(at)
        at += counts[n]
    count = min(groups, total)
    bounds = sorted({total * g // count for g in range(count + 1)})
    if len(lengths) <= groups:  # few enough as they are: a group for each
        bounds = [*starts, total]
    length_at = lambda r: lengths[bisect_left(starts, r + 1) - 1]
    sizes, demand, used = [length_at(b) for b in bounds[:-1]], [b - a for a, b in zip(bounds, bounds[1:], strict=False)], [0] * (len(bounds) - 1)

    def place(rank: int, n: int, first: int, each: int) -> None:
        """Ranks of all lengths as ranks of each length; a sequence's share may span lengths, so cut where it does."""
        end = rank + n
        while rank < end:
            i = bisect_left(starts, rank + 1) - 1
            stop = min(end, starts[i] + counts[lengths[i]])
            whole = (stop - rank) // each * each
            if whole:
                out.append((lengths[i], rank - starts[i], rank - starts[i] + whole, first, each))
                first += whole // each
                rank += whole
            rest = each
            if rank < stop:  # the sequence that takes pieces of this length and of the next ones
                while rest:
                    i = bisect_left(starts, rank + 1) - 1
                    m = min(rest, starts[i] + counts[lengths[i]] - rank)
                    out.append((lengths[i], rank - starts[i], rank - starts[i] + m, first, m))
                    rank += m
                    rest -= m
                first += 1

    for pattern, times in configurations(sizes, demand, capacity):
        for g, a in enumerate(pattern):
            if a:
                place(bounds[g] + used[g], a * times, sequences, a)
                used[g] += a * times
        sequences += times
    rooms: list[tuple[int, int]] = []  # what rounding down left over: best fit, decreasing
    for g in range(len(sizes)):
        for r in range(bounds[g] + used[g], bounds[g + 1]):
            n = length_at(r)
            i = bisect_left(rooms, (n, -1))
            if i == len(rooms):
                room, seq = capacity, sequences
                sequences += 1
            else:
                room, seq = rooms.pop(i)
            place(r, 1, seq, 1)
            if room > n:
                new = (room - n, seq)
                rooms.insert(bisect_left(rooms, new), new)
    return out, sequences


def small_plan(counts: dict[int, int], rooms: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """For small lengths: rows (length, first rank, end rank, room, first place), and the number of new sequences.

    Places are ranks among the sequences that have this room; room -1 stands for new sequences. Best fit, decreasing, over runs
    of sequences that are alike so far.
    """
    runs: dict[int, list[tuple[int, int, int]]] = {r: [(r, 0, n)] for r, n in rooms.items() if r > 0 and n}
    out, new = [], 0
    for s in sorted(counts, reverse=True):
        rank, left = 0, counts[s]
        while left:
            r = next((r for r in range(s, capacity + 1) if runs.get(r)), None)
            if r is None:
                n = max(1, left // (capacity // s))
                runs.setdefault(capacity, []).append((-1, new, new + n))
                new += n
                continue
            origin, a, b = runs[r].pop()
            n = min(left, b - a)
            out.append((s, rank, rank + n, origin, a))
            if a + n < b:
                runs[r].append((origin, a + n, b))
            if r > s:
                runs.setdefault(r - s, []).append((origin, a, a + n))
            rank += n
            left -= n
    return out, new


# --- carrying it out ---


def ranked(df: DataFrame, kind: str, order: list[str], most: int) -> DataFrame:
    """df with `rank`, gapless from 0 within each value of `kind`, of which no value has more than `most` rows. Ranks are counted
    within parts of about RANK_ROWS rows, then shifted: no value is one task."""
    df = df.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(1 + most // RANK_ROWS)).cast("int"))
    counts = df.groupBy(kind, "part").count()
    shift = counts.withColumn("shift", F.coalesce(F.sum("count").over(Window.partitionBy(kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(kind, "part", "shift")
    within = Window.partitionBy(kind, "part").orderBy(*[F.col(c).asc_nulls_first() for c in order])
    # The rows are dealt by (kind, part) for the window already, so the join moves the shifts only.
    return df.withColumn("rank", F.row_number().over(within) - 1).join(shift, [kind, "part"]).withColumn("rank", (F.col("rank") + F.col("shift")).cast("long")).drop("part", "shift")


def packed(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    """pieces (doc_id, piece, start, length, ids_crc32) with sequence_id and offset. `pieces` is read several times: give a written table."""
    spark = pieces.sparkSession
    order = ["doc_id", "piece", "start", "ids_crc32"]
    counts = {n: c for n, c in pieces.groupBy("length").count().collect()}
    rows, sequences = large_plan({n: c for n, c in counts.items() if n >= small}, capacity, groups)
    all_ranked = written(ranked(pieces, "length", order, max(counts.values(), default=0)), "ranked")
    plan = spark.createDataFrame(rows, "length long, low long, high long, first long, each long")
    # The plans have a few rows for each length, group and pattern, however many pieces there are: bounded broadcasts.
    mine = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    large = all_ranked.filter(F.col("length") >= small).join(F.broadcast(plan), "length").filter(mine)
    large = large.withColumn("sequence_id", F.col("first") + F.expr("(rank - low) div each")).drop("low", "high", "first", "each", "rank")
    fill = large.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).alias("room")).filter("room > 0")
    little = {n: c for n, c in counts.items() if n < small}
    if little:
        seats = written(ranked(fill, "room", ["sequence_id"], sequences), "seats")
        rooms = {r: c for r, c in seats.groupBy("room").count().collect()}
        more, _ = small_plan(little, rooms, capacity)
        places = spark.createDataFrame(more, "length long, low long, high long, room long, seat long")
        put = all_ranked.filter(F.col("length") < small).join(F.broadcast(places), "length").filter(mine).withColumn("seat", F.col("seat") + F.col("rank") - F.col("low")).drop("low", "high", "rank")
        old = put.filter("room >= 0").join(seats.withColumnRenamed("rank", "seat"), ["room", "seat"])
        fresh = put.filter("room < 0").withColumn("sequence_id", F.col("seat") + F.lit(sequences))
        large = large.unionByName(old.drop("room", "seat")).unionByName(fresh.drop("room", "seat"))
    along = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *[F.col(c).asc_nulls_first() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return large.withColumn("offset", F.sum("length").over(along) - F.col("length")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_TOKEN, groups: int = GROUPS, small: int = SMALL) -> DataFrame:
    return packed(written(tokenized(docs, path, capacity, end), "pieces"), capacity, groups, small)
