"""Sources and sinks of comment pools: JSON lines, zip archives, protobuf segments, lists; resumable writes.

Binary containers (zip, protobuf) are decoded in Arrow batches; everything else is plain DataFrame reading.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMENT = "id long, progress_ms long, timeline_ms long, mode int, content string, ctime long, cid long, page int"
META = "bvid string, title string, `group` string, group_title string, parts array<struct<page int, cid long, duration int>>"


def _stem(path: Column) -> Column:
    return F.regexp_extract(F.try_url_decode(path), r"([^/]*?)(?:\.meta)?(?:\.json)?l?(?:\.gz)?$", 1)


def read_comments(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """One row a comment of *.jsonl(.gz) files: bvid (the file's stem), ord (its place), the comment's fields.

    Blank lines are dropped. Broken lines are dropped, or raise where strict. A field of another type is null; its row stays.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("ord")).filter(F.trim("value") != "")
    ok = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    if strict:
        lines = lines.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("broken line: "), F.substring("value", 1, 80)))))
    else:
        lines = lines.filter(ok)
    return _fields(lines).withColumn("bvid", _stem(F.col("file"))).drop("file")


def _fields(lines: DataFrame) -> DataFrame:
    kinds = [f.strip().rsplit(" ", 1) for f in COMMENT.split(",")]
    fields = [F.get_json_object("value", f"$.{n}").try_cast(k).alias(n) for n, k in kinds]
    return lines.select(*[c for c in lines.columns if c != "value"], *fields)


def skipped_lines(spark: SparkSession, path: str) -> DataFrame:
    """(bvid, skipped): how many lines of each file are broken."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")
    return lines.groupBy(_stem(F.col("file")).alias("bvid")).agg(F.count_if(bad).alias("skipped"))


def corpus_index(listed: DataFrame | None, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(videos at hand, in the list's order; listed ones that are missing). Without a list, all files. files: bvid, ..."""
    if listed is None:
        return files, files.limit(0)
    return listed.join(files, "bvid").orderBy("list_ord"), listed.join(files, "bvid", "left_anti")


def read_archive(spark: SparkSession, path: str, limit_videos: int | None = None, skip_bad: bool = False) -> DataFrame:
    """unzipped() of the files at a path."""
    return unzipped(spark.read.format("binaryFile").load(path), limit_videos, skip_bad)


def unzipped(files: DataFrame, limit_videos: int | None = None, skip_bad: bool = False) -> DataFrame:
    """Comments of zip archives of <folder>/<video>.meta.json and <folder>/<video>.jsonl.gz members.

    (pool, bvid, title, parts, ord, value, broken): a row a line; broken lines come marked where skip_bad, else they raise.
    """
    import gzip

    columns = "pool string, bvid string, title string, parts array<struct<page:int,duration:int>>, ord long, value string, broken boolean"
    parts = pa.list_(pa.struct([("page", pa.int32()), ("duration", pa.int32())]))
    kinds = [pa.string(), pa.string(), pa.string(), parts, pa.int64(), pa.string(), pa.bool_()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pool = name.rsplit("/", 1)[-1].removesuffix(".zip")
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    members = sorted(n for n in z.namelist() if n.endswith(".jsonl.gz"))[:limit_videos]
                    for member in members:
                        stem = member.removesuffix(".jsonl.gz")
                        meta = json.loads(z.read(f"{stem}.meta.json")) if f"{stem}.meta.json" in z.namelist() else {}
                        rows = []
                        for line in gzip.decompress(z.read(member)).decode("utf-8", "replace").splitlines():
                            if line.strip():
                                try:
                                    bad = not isinstance(json.loads(line), dict)
                                except ValueError:
                                    if not skip_bad:
                                        raise
                                    bad = True
                                rows.append((line, bad))
                        shape = [{"page": p.get("page") or i + 1, "duration": p.get("duration")} for i, p in enumerate(meta.get("parts") or [])]
                        found = [(pool, stem.rsplit("/", 1)[-1], meta.get("title") or "", shape, i, x, bad) for i, (x, bad) in enumerate(rows)]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate(kinds)], [c.split(" ")[0] for c in ("pool", "bvid", "title", "parts", "ord", "value", "broken")])

    return files.select("path", "content").mapInArrow(run, columns)


def archive_comments(archive: DataFrame) -> DataFrame:
    """The comments of read_archive(), broken lines left out."""
    return _fields(archive.filter("not broken").drop("broken"))


# --- protobuf segments ---


class BrokenMessage(ValueError):
    pass


def varint(data: bytes, at: int) -> tuple[int, int]:
    n = 0
    for k in range(at, min(at + 10, len(data))):
        n |= (data[k] & 0x7F) << 7 * (k - at)
        if data[k] < 0x80:
            return n, k + 1
    raise BrokenMessage("varint cut off or too long")


def fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(field, wire type, value) of a message."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
            yield key >> 3, kind, value
            continue
        if kind == 2:
            n, at = varint(data, at)
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
        else:
            raise BrokenMessage(f"wire type {kind}")
        yield key >> 3, kind, data[at : at + n]
        at += n


#: Fields of an element of a segment.
ELEMENT = {1: "id", 2: "progress_ms", 3: "mode", 8: "ctime"}


def segment_comments(data: bytes) -> list[dict]:
    """Comments of a segment (repeated field 1); those without content are dropped."""
    out = []
    for number, kind, body in fields(data):
        if (number, kind) == (1, 2):
            row = dict.fromkeys(ELEMENT.values()) | {"content": ""}
            for n, k, value in fields(body):
                if k == 0 and n in ELEMENT:
                    row[ELEMENT[n]] = value
                elif (n, k) == (7, 2):
                    row["content"] = value.decode("utf-8", "replace")
            if row["content"]:
                out.append(row)
    return out


def segment_count(data: bytes) -> int | None:
    """The number of segments that a view message states (field 4, then 2)."""
    return next((v for n, k, body in fields(data) if (n, k) == (4, 2) for m, w, v in fields(body) if (m, w) == (2, 0)), None)


def decode_segments(files: DataFrame, id_col: str = "path", data_col: str = "content") -> DataFrame:
    """(id, ord, comment fields) of binary segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, n, r) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for n, r in enumerate(segment_comments(data or b""))]
            kinds = {"id": pa.int64(), "progress_ms": pa.int64(), "mode": pa.int32(), "content": pa.string(), "ctime": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([r[2][k] for r in rows], t) for k, t in kinds.items())], [id_col, "ord", *kinds])

    kind = dict(files.dtypes)[id_col]
    return files.select(id_col, F.col(data_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, ord long, id long, progress_ms long, mode int, content string, ctime long")


def assembled(segments: DataFrame, parts: DataFrame) -> DataFrame:
    """Comments of a video's parts on one time line.

    segments: bvid, cid, comment fields. parts: bvid, page, cid, duration (s). Equal (cid, id, progress, content) count once;
    progress is shifted by the parts before; ordered by (timeline_ms, id) within the video as `ord`.
    """
    before = F.coalesce(F.sum("duration").over(Window.partitionBy("bvid").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) * 1000
    shifted = parts.withColumn("shift_ms", before.cast("long")).select("bvid", "cid", "page", "shift_ms")
    rows = segments.dropDuplicates(["bvid", "cid", "id", "progress_ms", "content"]).join(shifted, ["bvid", "cid"])
    rows = rows.withColumn("timeline_ms", F.coalesce("progress_ms", F.lit(0)) + F.col("shift_ms")).drop("shift_ms")
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("bvid").orderBy("timeline_ms", "id")) - 1)


# --- sinks ---


def write_comments(comments: DataFrame, path: str) -> None:
    """Gzipped JSON lines in a folder for each video."""
    comments.write.mode("overwrite").partitionBy("bvid").option("compression", "gzip").json(path)


def left_to_do(listed: DataFrame, done: DataFrame, shard: int = 0, shards: int = 1) -> DataFrame:
    """Listed videos of this shard (place modulo shards) without an output yet."""
    return shard_of(listed, "list_ord", shard, shards).join(done, "bvid", "left_anti")


def shard_of(df: DataFrame, place: str, shard: int, shards: int) -> DataFrame:
    return df.filter(F.pmod(F.col(place), F.lit(shards)) == shard)


def write_summary(df: DataFrame, path: str, text_columns: tuple[str, ...] = ("content", "text", "norm")) -> None:
    """JSON of aggregates; refuses columns of raw text. Spark's commit protocol makes the write atomic."""
    if bad := set(df.columns) & set(text_columns):
        raise ValueError(f"a summary must not hold raw text: {sorted(bad)}")
    df.write.mode("overwrite").json(path)


def looks_complete(data: Column, expected: Column) -> Column:
    """A download's bytes: as many as expected; else known by its first bytes; else over 8192."""
    head = F.substring(data, 1, 4)
    magic = (head == F.lit(b"%PDF")) | (F.substring(data, 1, 2) == F.lit(b"PK"))
    return F.when(expected.isNotNull(), F.length(data) >= expected).otherwise(magic | (F.length(data) > 8192))


def last_by_name(downloads: DataFrame) -> DataFrame:
    """A download list with one URL a file name: the last one. downloads: ord, file, url."""
    return downloads.groupBy("file").agg(F.max_by("url", "ord").alias("url"), F.min("ord").alias("ord"))
