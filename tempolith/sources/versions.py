"""Versioned tables, publishing behind an audit, and stored files against recorded digests.

SNK-03, SNK-04, ORC-09, ORC-15, NST-09, ORC-27.

A version is a folder of Parquet that is never written again and one small record that names it. A write that fails leaves no record, so
the version before stays in force; readers that hold an older version go on reading it. The record is created under the next
number and creation fails if another writer has that number, so of two writers one wins and the other is told.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assemble

RECORD = "version LONG, data STRING, rows LONG, note STRING"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it; only a local session may do without."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tempolith-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tempolith-{spark.sparkContext.applicationId}"


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder of that name that nothing is in yet, deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    files, target = _files(spark, path)
    files.mkdirs(target)
    files.deleteOnExit(target)
    return path


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


class ConflictError(Exception):
    """Another writer has published under the same number."""


class VersionedTable:
    """A table at ``path`` whose every version can be read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- writing

    def stage(self, df: DataFrame) -> str:
        """Write ``df`` where no reader of the table looks, and return the place."""
        data = f"{self.path}/data/{uuid.uuid4().hex}"
        df.write.parquet(data)
        return data

    def publish(self, data: str, note: str = "", number: int | None = None) -> int:
        """Make a staged place the version in force. ``number`` is the one that the writer expects, the next by default."""
        number = number or self._last() + 1
        record = {"version": number, "data": data, "rows": self.spark.read.parquet(data).count(), "note": note}
        files, target = _files(self.spark, f"{self.path}/versions/{number:08d}.json")
        try:
            out = files.create(target, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise ConflictError(f"version {number} of {self.path} exists") from e
            raise
        out.write(bytearray(json.dumps(record).encode() + b"\n"))
        out.close()
        return number

    def write(self, df: DataFrame, note: str = "") -> int:
        return self.publish(self.stage(df), note)

    def audited(self, df: DataFrame, rules: Callable[[DataFrame], DataFrame], note: str = "", *, stop: Sequence[str] = ("abort",)) -> tuple[int | None, DataFrame]:
        """Write, read back, judge what was read, and publish unless an issue has a level of ``stop``.

        Returns the version (none if it was not published) and the issues, written down.
        """
        data = self.stage(df)
        at = f"{self.path}/audits/{uuid.uuid4().hex}"
        rules(self.spark.read.parquet(data)).write.parquet(at)
        issues = self.spark.read.parquet(at)
        if issues.where(F.col("level").isin(*stop)).limit(1).count():
            self._delete(data)
            return None, issues
        return self.publish(data, note), issues

    def restore(self, version: int) -> int:
        """An older version in force again, as the newest."""
        return self.publish(self._record(version)["data"], f"restored {version}")

    def vacuum(self, keep: int) -> list[int]:
        """Delete all but the newest ``keep`` versions, and places that no version names; returns the numbers that went."""
        records = self._records()
        held = {r["data"] for r in records[-keep:]}
        gone = [r["version"] for r in records[:-keep]]
        for number in gone:
            self._delete(f"{self.path}/versions/{number:08d}.json")
        files, target = _files(self.spark, f"{self.path}/data")
        for status in files.listStatus(target) if files.exists(target) else ():
            place = status.getPath()
            if place.getName() not in {d.rpartition("/")[2] for d in held}:
                files.delete(place, True)
        return gone

    # --- reading

    def versions(self) -> DataFrame:
        """One row for each version that can be read."""
        if not self._last():
            return self.spark.createDataFrame([], RECORD)
        return self.spark.read.schema(RECORD).json(f"{self.path}/versions").where("version is not null")

    def current(self) -> int | None:
        records = self._records()
        return records[-1]["version"] if records else None

    def read(self, version: int | None = None) -> DataFrame:
        """The version in force, or an older one."""
        return self.spark.read.parquet(self._record(version)["data"])

    def appended(self) -> DataFrame:
        """The rows of all versions: a table whose writers only add to it."""
        return self.spark.read.parquet(*[r["data"] for r in self._records()])

    def _records(self) -> list[dict]:
        return [r.asDict() for r in self.versions().orderBy("version").collect()]  # a row for each version

    def _record(self, version: int | None) -> dict:
        found = [r for r in self._records() if version is None or r["version"] == version]
        if not found:
            raise ValueError(f"{self.path} has no version {'at all' if version is None else version}")
        return found[-1]

    def _last(self) -> int:
        files, target = _files(self.spark, f"{self.path}/versions")
        names = [s.getPath().getName() for s in files.listStatus(target)] if files.exists(target) else []
        return max((int(n[:8]) for n in names if n.endswith(".json") and n[:8].isdigit()), default=0)

    def _delete(self, path: str) -> None:
        files, target = _files(self.spark, path)
        files.delete(target, True)


def page_changes(old: DataFrame, new: DataFrame, *, key: Sequence[str], order: str, time: str, fields: Sequence[Column], version: str = "pages/1") -> DataFrame:
    """Two versions of a page table by key: pages before and now, whether their order or times (to a tenth) differ, and whether
    anything of ``fields`` does. A key that one of the versions lacks has 0 pages there."""
    tenth = F.format_string("%.1f", F.bround(time, 1).cast("double"))

    def told(df: DataFrame, name: str) -> DataFrame:
        places = assemble.canonical_digest(df, key=key, order=[order], fields=[F.col(order), tenth], version=version)
        whole = assemble.canonical_digest(df, key=key, order=[order], fields=[F.col(order), tenth, *fields], version=version)
        return places.select(*key, F.col("digest").alias(f"places_{name}")).join(whole.select(*key, F.col("digest").alias(f"whole_{name}"), F.col("count").alias(f"pages_{name}")), list(key))

    both = told(old, "before").join(told(new, "now"), list(key), "full")
    pages = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("pages_before", "pages_now")]
    differ = lambda c: (~F.col(f"{c}_before").eqNullSafe(F.col(f"{c}_now")))
    return both.select(*key, *pages, differ("places").alias("order_changed"), differ("whole").alias("identity_changed"))


# --- files -----------------------------------------------------------------------------------------------------------


def write_pages(df: DataFrame, path: str, *, key: Sequence[str], text: str) -> None:
    """One text file for each row, in folders named by ``key``; Spark's commit leaves whole files only."""
    df.select(*key, F.col(text).alias("value")).write.partitionBy(*key).text(path)


def file_digests(spark: SparkSession, path: str, *, key: Sequence[str], pattern: str = "*.txt") -> DataFrame:
    """The key, digest and bytes of every file under ``path``, digests made in the scan: contents go nowhere."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(*key, assemble.file_digest(F.col("content")).alias("actual"), F.col("length").alias("bytes"))


def recomputed(pages: DataFrame, files: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Recorded digests (``recorded``) against those of the files: same, changed, missing, or unrecorded."""
    both = pages.select(*key, "recorded", F.lit(True).alias("_page")).join(files, list(key), "full")
    state = F.when(F.col("_page").isNull(), "unrecorded").when(F.col("actual").isNull(), "missing").when(F.col("actual").eqNullSafe(F.col("recorded")), "same").otherwise("changed")
    return both.withColumn("state", state).drop("_page")


def recomputed_sets(pages: DataFrame, files: DataFrame, *, key: Sequence[str], page: str, version: str = "pages/1") -> DataFrame:
    """For each set of pages (``key``) the recorded and the recomputed identity, and which pages are missing or changed."""
    states = recomputed(pages, files, key=[*key, page])
    listed = lambda s: F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col(page)))).alias(s)
    was = assemble.canonical_digest(pages, key=key, order=[page], fields=[F.col(page), F.col("recorded")], version=version)
    now = assemble.canonical_digest(states.where("actual is not null"), key=key, order=[page], fields=[F.col(page), F.col("actual")], version=version)
    told = states.groupBy(*key).agg(listed("missing"), listed("changed"), listed("unrecorded"))
    named = lambda df, n: df.select(*key, F.col("digest").alias(n))
    return told.join(named(was, "recorded_id"), list(key), "left").join(named(now, "actual_id"), list(key), "left")
