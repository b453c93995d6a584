"""Sessions for tests and benchmarks. On a cluster the session comes from outside."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int, *, shuffle_partitions: int | None = None, memory: str = "8g", warehouse: str | None = None, checkpoint: str | None = None) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions or cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        # a lookahead of n-grams or a long regex is work worth dealing out: one row group, several tasks
        "spark.sql.files.maxPartitionBytes": "32m",
    }
    if warehouse:
        conf["spark.sql.warehouse.dir"] = warehouse
    if checkpoint:
        conf["spark.checkpoint.dir"] = checkpoint
    return SparkSession.builder.master(f"local[{cpus}]").appName("tempolith").config(map=conf).getOrCreate()
