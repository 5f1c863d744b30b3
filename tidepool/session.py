"""A local session with this package's defaults; on a cluster, pass your own session to any function instead."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def session(name: str = "tidepool", more: dict[str, str] | None = None, cpus: str = "8") -> SparkSession:
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.driver.host": "127.0.0.1",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=conf | (more or {})).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
