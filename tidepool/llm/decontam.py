"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may differ from a passage by k = floor(n * rate) edits. Cut into k + 1 pieces, at least one piece then
occurs unchanged. All pieces go into one Aho-Corasick automaton; each exact hit names an item and where it would begin, and
Myers' bit-parallel algorithm finds the least edit distance of the item to any passage around there.

Texts are compared in lower case, with each run of white space as one space. An item is reported once a document: its least
distance, the leftmost end among those. Items and texts that are null, empty or blank match nothing. Rows with equal ids are
reported row by row; equal items each by their id. Columns other than ids and texts are ignored, whatever their names. An empty
table of documents, or of items, gives no rows. Texts of any length are searched whole, one at a time.

The items are a test set, so they are small beside the corpus, but nothing relies on it: they are taken in blocks of at most
BLOCK_CHARS characters (a longer item is a block), and each block is one pass over all texts. Nothing is shuffled but items.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import lean, small_batches

RATE = 0.06
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def budget(n: int, rate: float) -> int:
    return int(n * rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces whose lengths differ by one at most."""
    n = len(item)
    bounds = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(bounds, bounds[1:], strict=False) if b > a]


def myers(item: str, text: str, k: int, masks: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(least distance, end) of item against any part of text, if that is k at most; the leftmost end."""
    m = len(item)
    masks = masks or peq(item)
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best = full, 0, m, None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, i + 1)
    return best


def peq(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


class Matcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, raw in items if (t := normal(raw))]
        self.masks = [peq(t) for _, t, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = {}
        for at, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                found.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in found.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if found:
            self.automaton.make_automaton()
        self.empty = not found

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item id, distance, end, item length) of each item in the text, positions in its normal form."""
        text = normal(text)
        if self.empty or not text:
            return []
        windows: dict[int, list[list[int]]] = {}
        for end, (length, owners) in self.automaton.iter(text):
            for at, offset in owners:
                _, item, k = self.items[at]
                begin = end + 1 - length - offset
                low, high = max(0, begin - k), min(len(text), begin + len(item) + k)
                spans = windows.setdefault(at, [])
                for span in reversed(spans[-4:]):  # hits of one passage mostly give one window
                    if low <= span[1] and high >= span[0]:
                        span[0], span[1] = min(span[0], low), max(span[1], high)
                        break
                else:
                    spans.append([low, high])
        out = []
        for at, spans in windows.items():
            ident, item, k = self.items[at]
            hits = [(d, low + e) for low, high in spans if (hit := myers(item, text[low:high], k, self.masks[at])) for d, e in [hit]]
            if hits:
                d, e = min(hits)
                out.append((ident, d, e, len(item)))
        return sorted(out)


def leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(doc_id, item_id, distance, match_end, item_chars): test items that documents contain within `rate` edits a character."""
    small_batches(docs.sparkSession)
    names = "doc_id long, item_id long, distance int, match_end int, item_chars int"
    docs = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    def over(block: list[tuple[int, str]]) -> DataFrame:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in matcher.matches(t)]
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split(" ")[0] for c in names.split(", ")])

        return docs.mapInArrow(run, names)

    return reduce(DataFrame.unionByName, [over(block) for block in _blocks(items, block_chars)])


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items (item_id, text), in blocks that hold about block_chars characters at most."""
    chars = items.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = -(-2 * chars // block_chars) if chars > block_chars else 1
    for n in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n) if blocks > 1 else items
        yield [tuple(r) for r in mine.collect()]


def without_leaks(docs: DataFrame, items: DataFrame, rate: float = RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs whose text contains no test item, with their columns as they are."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")

    def clean(block: list[tuple[int, str]]):
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.matches(t) for t in b.column(at).to_pylist()], pa.bool_()))

        return run

    for block in _blocks(items, block_chars):
        docs = docs.mapInArrow(clean(block), docs.schema)
    return docs
