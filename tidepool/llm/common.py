"""What several operators share: the shared folder, written tables, hashing, connected components."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Only where the session names no folder and all runs on one machine, as in tests.
FALLBACK_DIR = "/tmp/checkpoints/tidepool"
#: Arrow batches of this many rows keep a batch of long texts within a worker's memory.
BATCH_ROWS = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset: a default if all runs on one machine, else an error."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or FALLBACK_DIR).rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: hand Python few rows at a time. Shuffle files need not outlive what read them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet in the shared folder and reread it: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    spark.sparkContext._jvm.System.gc()  # Spark deletes shuffle files once the driver has collected what refers to them
    out = spark.read.schema(df.schema).parquet(path)
    out._tidepool_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._tidepool_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with what it freed given back at its end: Spark keeps Python workers, also idle ones, and each would hold its largest task's memory."""

    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return leaner


def give_back() -> None:
    """Free memory of Arrow's pool and of the C library (where that can be) goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


class WordHashes(dict):
    """64-bit hashes of words as bytes, remembered up to a limit."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64), vectorised; overflow wraps."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Edges of one node that one task may join.
HUB = 100_000


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60, hub: int = HUB) -> DataFrame:
    """(node, root): the smallest node reachable over undirected edges, for each node of an edge.

    Alternating large-star and small-star rounds (Kiveris et al. 2014) until the edges stay as they are. Each round is
    written to the shared folder, so lineage stays short and a lost executor costs one round at most. Minima are taken
    by partial aggregation and joined back; the edges of a node that has more than `hub` are salted over several tasks.
    """
    e = written(_ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v"))), "edges")
    before, count = None, e.count()
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).withColumn("m", F.least("u", "m"))
        large = written(_ordered(_salted(both, low, hub, count).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        small = _salted(large, low, hub, 2 * count).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = written(_ordered(small), "edges")
        forget(large, e)
        e = new
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, count = now, now[0]
    else:
        raise RuntimeError("connected components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()


def _salted(rows: DataFrame, low: DataFrame, hub: int, count: int) -> DataFrame:
    """rows (u, v) with m of their u; low: u, m, degree. At most `count` edges in all."""
    if count <= hub:  # no node can have more
        return rows.join(low.select("u", "m"), "u")
    salts = F.ceil(F.col("degree") / hub).cast("int")
    hubs = F.broadcast(low.filter(F.col("degree") > hub).select("u", salts.alias("salts")))  # at most 2 * count / hub rows
    rows = rows.join(hubs, "u", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("salts")).cast("int")))
    return rows.join(low.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).select("u", "salt", "m"), ["u", "salt"]).select("u", "v", "m")


def _ordered(e: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, each once, without loops."""
    return e.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
