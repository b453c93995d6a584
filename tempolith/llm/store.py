"""Where operators of this subpackage keep what has to outlive a job.

Executors share only the folder named by ``spark.checkpoint.dir``; every intermediate table is written
there as Parquet, which cuts lineage and survives the loss of an executor.

Operators that add columns keep the caller's row in one struct meanwhile, so that names of their own never meet its
names. A column of the caller that has the name of a result stays, with ``_input`` after its name.
"""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_kept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session. Only where all of Spark is one process (as in tests) one is set if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/tempolith-shared"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/tempolith-{spark.sparkContext.applicationId}"
    if path not in _kept:  # what nobody deletes goes with the application
        _kept.add(path)
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(target)
        files.deleteOnExit(target)
    return path


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: For rows of megabytes: Parquet looks at what it holds after every row instead of after 100, and closes a row group beyond
#: these bytes. What a task holds of such a table while it writes or reads is one row or a few, however many it has.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(8 << 20)}


def materialise(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result no longer depends on how it was made."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tempolith_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete a table of ``materialise`` that nothing reads any more."""
    path = getattr(df, "_tempolith_path", None)
    if path:
        drop_path(df.sparkSession, path)


def column(name: str) -> Column:
    """A column by its whole name, whatever marks are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """A name like ``name`` that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def set_apart(df: DataFrame, results: Iterable[str], text: str) -> tuple[DataFrame, str]:
    """``df`` with its columns free of the names of ``results``, and what its column ``text`` is called now."""
    named = df.select(whole_row(df, results).alias("row")).schema["row"].dataType.fieldNames()
    return df.select(*[column(c).alias(n) for c, n in zip(df.columns, named, strict=True)]), named[df.columns.index(text)]


def whole_row(df: DataFrame, results: Iterable[str] = ()) -> Column:
    """All columns of ``df`` as one struct, free of the names of ``results``."""
    taken, fields = {r.lower() for r in results}, []
    held = taken | {c.lower() for c in df.columns}
    for c in df.columns:
        name = c
        if c.lower() in taken:
            while name.lower() in held:
                name += "_input"
            held.add(name.lower())
        fields.append(column(c).alias(name))
    return F.struct(*fields)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df`` (materialised ids), to be sent to every executor if it has no more than ``rows`` rows; beyond that a
    join exchanges both sides."""
    return F.broadcast(df) if df.count() <= rows else df


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids that may be sent to every executor, some 50 MB as a hash table; more are exchanged.
SENT_ROWS = 1_000_000


class Scratch:
    """Tables in the shared folder that can go together once what was made of them is written."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        out = materialise(df, name)
        self.tables.append(out)
        return out

    def drop(self, df: DataFrame) -> None:
        discard(df)
        self.tables = [t for t in self.tables if t is not df]

    def clear(self) -> None:
        for df in self.tables:
            discard(df)
        self.tables = []
