import random
import struct
import zlib
from collections import Counter

import public_tokenizers
import pytest

from tidepool.llm import packing as P

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_cuts():
    assert P.cuts(1, 1024) == [(0, 1)]
    assert P.cuts(1024, 1024) == [(0, 1024)]
    assert P.cuts(1025, 1024) == [(0, 1), (1, 1024)]
    assert P.cuts(4096, 1024) == [(0, 1024), (1024, 1024), (2048, 1024), (3072, 1024)]


def test_ids_equal_the_tokenizers_library(spark, odd_documents):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    texts = [r.text or "" for r in odd_documents.collect()] + ["a  b\t\n\n c's 'll ﬁ ①²  \r\n x" * 3, " " * 40, "ß" * 900, "1234567890" * 30]
    for text in texts:
        assert P.encoder(PATH).encode(text, allowed_special="all") == P.ids_of(text, PATH) == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "." * 2_000_000, " \n\t" * 700_000 + "end"])
def test_long_runs_are_tokenized_whole(text):
    from tokenizers import Tokenizer

    assert P.ids_of(text, PATH) == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed(spark):
    out = P.pack_documents(spark.createDataFrame([(1, " " * 1_000_000), (2, "x")], "doc_id long, text string"), PATH).collect()
    assert sum(r.length for r in out if r.doc_id == 1) == len(P.ids_of(" " * 1_000_000, PATH)) + 1


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(4))
def test_packs_whole_and_tight(spark, seed):
    rng = random.Random(seed)
    lengths = [rng.choice((rng.randrange(1, 1025), rng.randrange(1, 200), 1024, rng.randrange(300, 700))) for _ in range(1500)]
    rows = [(i, 0, 0, n, i) for i, n in enumerate(lengths)]
    out = P.packed(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")).collect()
    assert sorted((r.doc_id, r.length) for r in out) == sorted((i, n) for i, n in enumerate(lengths))
    bins = {}
    for r in sorted(out, key=lambda r: r.offset):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 1024
    assert len(bins) <= best_fit(lengths, 1024) * 1.01 + 2


def test_odd_rows(spark, odd_documents, no_documents):
    out = P.pack_documents(odd_documents, PATH).collect()
    for d in (3, 4):
        assert [(r.piece, r.start, r.length, r.ids_crc32) for r in out if r.doc_id == d] == [(0, 0, 1, zlib.crc32(struct.pack("<I", 2)))]
    assert len([r for r in out if r.doc_id == 1]) == 2
    long = sorted((r for r in out if r.doc_id == 8), key=lambda r: r.piece)
    assert [r.length for r in long[1:]] == [1024] * (len(long) - 1)
    assert max(Counter((r.sequence_id, r.offset) for r in out).values()) == 1
    assert P.pack_documents(no_documents, PATH).count() == 0
