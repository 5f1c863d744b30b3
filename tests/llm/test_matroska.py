import hashlib
import random
import zlib

from pyspark.sql import functions as F

from tidepool.llm import matroska as M


def test_round_trip_of_every_lacing():
    rng = random.Random(1)
    for n in (64, 448, 512, 576, 4096, 4160, 200_000 // 64 * 64):
        data = rng.randbytes(n)
        for lacing in ("auto", "xiph", "ebml", "none") if n else ():
            if lacing == "none" and n > 512:
                continue
            media = M.parse(file := M.mux(data, lacing))
            assert media.error is None and media.doc_type == "matroska"
            assert b"".join(file[p[6] : p[6] + p[7]] for p in media.packets) == data
            assert [t["codec"] for t in media.tracks] == ["A_PCM/INT/LIT"] and media.tracks[0]["bits"] == 8
            assert len(media.cues) == media.clusters
            assert all(file[at : at + 4] == M.CLUSTER.to_bytes(4, "big") for _, _, at in media.cues)
            stamps = [p[1] for p in media.packets]
            assert stamps == [i * M.FRAME * 10**9 // M.RATE for i in range(len(stamps))]


def test_unknown_sizes_groups_and_faults():
    ones = lambda ident: ident.to_bytes((ident.bit_length() + 7) // 8, "big") + b"\x01" + b"\xff" * 7
    track = M.element(M.TRACKS, M.element(M.TRACK_ENTRY, M.number(M.TRACK_NUMBER, 1) + M.number(M.DEFAULT_DURATION, 10)))
    frames = [bytes([i]) * n for i, n in enumerate((300, 5, 255, 0, 70_000))]
    group = M.element(M.BLOCK_GROUP, M.block(M.BLOCK, 1, -2, frames, "ebml", 0) + M.number(M.REFERENCE_BLOCK, 1))
    cluster = ones(M.CLUSTER) + M.number(M.TIMESTAMP, 7) + group + M.block(M.SIMPLE_BLOCK, 1, 0, frames, "xiph")
    file = M.element(M.EBML, M.element(M.DOC_TYPE, b"webm")) + ones(M.SEGMENT) + track + cluster + cluster
    media = M.parse(file)
    assert media.error is None and media.clusters == 2 and len(media.packets) == 20
    for at in range(0, 20, 5):
        assert [file[p[6] : p[6] + p[7]] for p in media.packets[at : at + 5]] == frames
    assert [p[2] for p in media.packets[:10]] == [False] * 5 + [True] * 5
    assert media.packets[0][1] == 5_000_000 and media.packets[1][1] == 5_000_010
    assert M.parse(file[:-10]).error and len(M.parse(file[:-10]).packets) == 15
    assert M.parse(b"\0junk").error and M.parse(None).error is None


def test_tables_and_digest(spark, odd_documents, no_documents):
    files = M.stored(odd_documents)
    rows = M.media_summary(files).collect()
    want = [(t or "").encode() for _, t, *_ in odd_documents.collect()]
    assert sorted((len(t), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])) for t in want for p in [M.padded(t)]) == sorted((r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows)
    assert all(r.error is None for r in rows)
    one = [r for r in rows if r.doc_id == 1]
    assert one[0] == one[1]
    total = M.packets(files).agg(F.sum("length")).first()[0]
    assert total == sum(r.payload_bytes for r in rows)
    assert M.tracks(files).count() == len(rows) and M.cues(files).filter("doc_id = 8").count() > 1
    assert M.media_summary(M.stored(no_documents)).count() == 0
    assert M.packets(spark.createDataFrame([(1, None)], "doc_id long, media binary")).count() == 0
