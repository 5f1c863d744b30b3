"""Language-model scores by stupid backoff (Brants et al. 2007) of order 3 over the scored corpus itself, leaving one out.

The score of a word after two others is c(a b c) / c(a b) where another document has that trigram; else ALPHA times
c(b c) / c(b) where another one has that bigram; else ALPHA^2 times c(c) / N. The first two words of a document have as much
context as there is. All counts are those of the other documents (the document's own are subtracted), so a text is not its own
model; a word that no other document has counts as 1. A document's score is the sum of the logarithms over its words.

1. Documents are gathered into flushes of about FLUSH_WORDS words, which are written as numbers of words. Each distinct n-gram of a
   flush, of any order, is exploded once, with its count there, and partitioned by its hash: the n-gram count tables, an exchange of
   one key for each n-gram and flush. A frequent n-gram gives a flush one key, however many documents have it, so no key is hot. Keys
   travel in blocks of columns, a block a bucket of hashes, sorted and as differences. This goes in PASSES rounds, each for its range
   of hashes, so that disks hold the keys of one round at a time.
2. Each bucket counts its n-grams over all flushes by a sort, joins the counts to the blocks, and sends them back to their flushes.
   The number of buckets grows with the bytes of text, so a bucket keeps its size.
3. Each flush joins the counts to the n-grams of its documents, takes off each document's own, and sums the terms by document, in the
   order of the words: scores do not depend on how rows are dealt to tasks.
4. N is the sum of the words of all documents, known once all are scored; it enters by the number of terms that hold it.

Words are lower-cased (A-Z) runs of anything but space and U+0009..U+000D, told apart by 64-bit hashes, as n-grams are. A null,
empty or blank text has no words, the score 0 and no mean. Equal rows are scored each, as copies of each other; ids play no part,
so null and repeated ones are scored like others. Extra columns are ignored, also where their names are those of the result; an
empty table gives no rows. A text of any length is scored whole: a task holds its words, at about 100 bytes each.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import WordHashes, mix64, small_batches, written

ALPHA, ORDER = 0.4, 3
#: Words that a task gathers as one flush.
FLUSH_WORDS = 450_000
#: Bytes of text for each bucket of n-grams: about a million keys, at 30 bytes each in the task that counts them.
BUCKET_BYTES = 4_000_000
#: Buckets that one task counts, one after the other.
BUCKETS_A_TASK = 4
#: Rounds of exploding and counting, each for an equal range of hashes.
PASSES = 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


class FewerHashes(WordHashes):
    LIMIT = 200_000


def word_hashes(text: bytes | None, words: WordHashes) -> np.ndarray:
    return np.frombuffer(array("Q", map(words.__getitem__, text.lower().split() if text else [])), np.uint64)


def grams(w: np.ndarray, lengths: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ends) of all n-grams of documents of these lengths, laid end to end: by order, then place; ends are places of last words."""
    place = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    keys, ends, h = [mix64(w)], [np.arange(len(w))], w
    for n in range(2, order + 1):
        h = h[:-1] * _STEP + w[n - 1 :]  # of the n words that end at n - 1, n, ...
        within = np.flatnonzero(place[n - 1 :] >= n - 1)
        keys.append(mix64(h[within] + np.uint64(n)))
        ends.append(within + n - 1)
    return np.concatenate(keys), np.concatenate(ends)


def planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte: all first bytes, then all second ones, which compresses better."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def packed(x: np.ndarray) -> bytes:
    return pa.compress(planes(x), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: str, n: int) -> np.ndarray:
    return unplanes(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


_HEADS = pa.schema([("flush", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("text", pa.binary())])
_HEAD_COLUMNS = "flush long, ids array<long>, lengths binary, words binary, text binary"
_BLOCKS = pa.schema([("flush", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
_BLOCK_COLUMNS = "flush long, bucket long, n long, keys binary, counts binary"


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)


def _flushes(flush_words: int):
    """Heads: the ids and lengths of a flush's documents, its distinct words' hashes, most frequent first, and the texts as numbers of these."""

    def flush(name: int, docs: list[tuple]) -> pa.RecordBatch:
        lengths, w = np.array([len(d[1]) for d in docs], np.uint32), np.concatenate([d[1] for d in docs])
        words, inverse, times = np.unique(w, return_inverse=True, return_counts=True)
        by_times = np.argsort(-times, kind="stable")
        number = np.empty(len(words), np.uint32)
        number[by_times] = np.arange(len(words), dtype=np.uint32)
        return _table([(name, [d[0] for d in docs], lengths.tobytes(), words[by_times].tobytes(), packed(number[inverse]))], _HEADS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, docs, held, made = FewerHashes(), [], 0, TaskContext.get().partitionId() << 32
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs.append((i, word_hashes(t, hashes)))
                held += len(docs[-1][1])
                if held >= flush_words or len(docs) >= flush_words // 4:
                    yield flush(made, docs)
                    docs, held, made = [], 0, made + 1
        if docs:
            yield flush(made, docs)

    return run


def _texts(head: dict) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, lengths) of a flush's documents."""
    lengths = np.frombuffer(head["lengths"], np.uint32).astype(np.int64)
    return np.frombuffer(head["words"], np.uint64)[unpacked(head["text"], "u4", int(lengths.sum()))], lengths


def _exploded(order: int, buckets: int, first: int, stop: int):
    """Blocks (flush, bucket, n, keys, counts) of the distinct n-grams of each flush, for buckets first to stop - 1: equal ranges of hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = np.array([(i << 64) // buckets for i in range(first, min(stop + 1, buckets))], np.uint64)
        for b in batches:
            for head in b.to_pylist():
                keys = grams(*_texts(head), order)[0]
                keys = keys[keys >= begins[0]] if stop == buckets else keys[(keys >= begins[0]) & (keys < begins[-1])]
                keys, counts = np.unique(keys, return_counts=True)
                edges = np.append(np.searchsorted(keys, begins[: stop - first]), len(keys)).tolist()
                out = []
                for bucket, (x, y) in enumerate(zip(edges, edges[1:], strict=False), first):
                    if x < y:
                        out.append((head["flush"], bucket, y - x, packed(np.diff(keys[x:y], prepend=np.uint64(0))), packed(counts[x:y].astype(np.uint32))))
                yield _table(out, _BLOCKS)

    return run


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Runs of rows that have the same value in a column."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and rows[-1][column] != r[column]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by bucket: each with how often its n-grams occur in other flushes, instead of the keys."""
    for rows in _runs(batches, "bucket"):
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], "u8", r["n"]), dtype=np.uint64) for r in rows])
        counts = np.concatenate([unpacked(r["counts"], "u4", r["n"]) for r in rows]).astype(np.int64)
        order = np.argsort(keys)
        edge = np.flatnonzero(np.diff(keys[order], prepend=~keys[order[0]]))
        others = np.empty(len(keys), np.int64)
        others[order] = np.repeat(np.add.reduceat(counts[order], edge), np.diff(np.append(edge, len(keys))))
        others -= counts
        stops = np.cumsum([r["n"] for r in rows]).tolist()
        yield _table([(r["flush"], r["bucket"], r["n"], None, packed(others[a:b].astype(np.uint32))) for r, a, b in zip(rows, [0, *stops], stops, strict=False)], _BLOCKS)


_SCORES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("known", pa.float64()), ("singles", pa.int64())])


def _scored(order: int, alpha: float):
    """Rows sorted by flush, then bucket, its head first: the documents' sums, and how many of their terms are divided by N."""

    def scores(rows: list[dict]) -> pa.RecordBatch:
        head = rows[0]
        w, lengths = _texts(head)
        keys, ends = grams(w, lengths, order)
        doc = np.repeat(np.arange(len(lengths)), lengths)
        by_key = np.argsort(keys, kind="stable")  # within a key, by place, hence by document
        gram = np.append(0, np.cumsum(np.diff(keys[by_key]) != 0)) if len(keys) else np.empty(0, np.int64)
        run = np.append(0, np.cumsum((np.diff(gram) != 0) | (np.diff(doc[ends[by_key]]) != 0))) if len(keys) else gram
        others = np.concatenate([np.empty(0, np.int64), *(unpacked(r["counts"], "u4", r["n"]).astype(np.int64) for r in rows[1:])])
        elsewhere = np.empty(len(keys), np.int64)
        elsewhere[by_key] = (others + np.bincount(gram, minlength=len(others)))[gram] - np.bincount(run)[run] if len(keys) else 0
        c = np.zeros((order + 1, len(w)), np.int64)  # of the n-gram that ends at each place; none where a document has no n words yet
        sizes = np.concatenate([np.full(len(w), 1), *(np.full(int(np.maximum(lengths - n + 1, 0).sum()), n) for n in range(2, order + 1))])
        c[sizes, ends] = elsewhere
        place = np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        term, level = np.log(np.maximum(c[1], 1)), np.ones(len(w), np.int64)
        for n in range(2, order + 1):
            at = np.flatnonzero(c[n] > 0)
            term[at] = np.log(c[n, at]) - np.log(c[n - 1, at - 1])
            level[at] = n
        term += np.log(alpha) * (np.minimum(place + 1, order) - level)
        known = np.bincount(doc, weights=term, minlength=len(lengths))
        singles = np.bincount(doc[level == 1], minlength=len(lengths))
        return pa.RecordBatch.from_arrays([pa.array(head["ids"], pa.int64()), pa.array(lengths), pa.array(known), pa.array(singles.astype(np.int64))], schema=_SCORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "flush"):
            yield scores(rows)

    return run


def backoff_scores(docs: DataFrame, alpha: float = ALPHA, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", flush_words: int = FLUSH_WORDS, bucket_bytes: int = BUCKET_BYTES, passes: int = PASSES) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    heads = written(docs.mapInArrow(_flushes(flush_words), _HEAD_COLUMNS), "flushes")
    buckets = passes * (1 + size // bucket_bytes // passes)
    each = buckets // passes
    tasks = 1 + each // BUCKETS_A_TASK
    both = heads
    for p in range(passes):
        blocks = heads.mapInArrow(_exploded(order, buckets, p * each, (p + 1) * each), _BLOCK_COLUMNS)
        # Buckets go round the tasks, so that each has as many.
        counted = blocks.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket").mapInArrow(_counted, _BLOCK_COLUMNS)
        both = both.unionByName(written(counted.drop("keys"), "counted"), allowMissingColumns=True)
    sums = both.repartition(1 + size // (8 * flush_words), "flush").sortWithinPartitions("flush", "bucket").mapInArrow(_scored(order, alpha), "doc_id long, n_words long, known double, singles long")
    sums = written(sums, "sums")
    total = sums.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    score = F.col("known") - F.col("singles") * F.log(F.greatest(F.lit(total) - F.col("n_words"), F.lit(1)).cast("double"))
    out = sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, score).otherwise(F.lit(0.0)).alias("log_score"))
    return out.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))
