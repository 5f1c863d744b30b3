"""A corpus pipeline: quality, near duplicates, benchmark leaks, packing. Each stage is written and reread as the next one's input.

Null, empty and blank texts: the first stage scores them by its bias alone; near duplicates keeps all of them, as they link with nothing;
they hold no test item; they are packed as their end token. Rows without an id pass all stages like others, but are never dropped
as near copies. Rows that repeat an id are told apart by their texts; of equal ones one stays. Of a group the smallest id stays, so ties
need no rule. Texts of any length are treated whole, one at a time in a task. Extra columns are carried along by all stages but the
last, whatever their names. An empty table gives no rows; without labels every score is 0.5 and all documents stay.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import decontam, nbsvm, ngram_join, packing
from tidepool.llm.common import written

#: No SQL expresses the classifier or the edit distance; tests hold each stage against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return nbsvm.good_only(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles."""
    return ngram_join.one_of_each(docs, k=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no test item within the edit budget."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("best-fit packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = written(docs, f"stage{n}")
    return docs
