"""State between runs: keyed patches, ledgers, rounds, apply-once stamps, read-through caches.

J-05, J-10, STA-01 to STA-12, AGG-08, AGG-09, SRC-04, SRC-19, NST-08, SET-08. Ledgers are
append-only tables; the latest row of a key is chosen by a total order, never by arrival.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _given(df: DataFrame, c: str) -> Column:
    """The column, null where it is an empty text or array."""
    kind = df.schema[c].dataType
    empty = F.col(c) == "" if isinstance(kind, T.StringType) else F.size(c) == 0 if isinstance(kind, T.ArrayType) else F.lit(False)
    return F.when(~F.coalesce(empty, F.lit(False)), F.col(c))


def patched(base: DataFrame, patches: DataFrame, *, key: Sequence[str], order: str, fields: Sequence[str]) -> DataFrame:
    """Upsert: for each field the value of the last patch (in ``order``) that gives one, else the base's.
    Empty texts and arrays and nulls don't overwrite."""
    last = [F.max_by(_given(patches, f), F.when(_given(patches, f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields]
    merged = base.join(patches.groupBy(*key).agg(*last), list(key), "left")
    return merged.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop(*[f"_{f}" for f in fields])


def unknown_patches(base: DataFrame, patches: DataFrame, *, key: Sequence[str]) -> DataFrame:
    return patches.join(base.select(*key), list(key), "left_anti").select(*key).distinct()


def pending(issues: DataFrame, rounds: DataFrame, *, key: Sequence[str] = (), include_done: bool = True) -> DataFrame:
    """Errors and major reviews per owner: count and first message, with the done flag of the last round. Done
    owners stay in the list unless told otherwise."""
    open_ = issues.where((F.col("level") == "error") | ((F.col("level") == "review") & (F.col("severity") == "major")))
    queue = open_.groupBy(*key, "owner").agg(F.count("*").alias("n"), F.min("message").alias("sample"))
    done = rounds.groupBy(*key, "owner").agg((F.max_by("result", F.struct("at", "round")) == "done").alias("done"))
    out = queue.join(done, [*key, "owner"], "left").withColumn("done", F.coalesce("done", F.lit(False)))
    return out if include_done else out.where("not done")


def next_round(rounds: DataFrame, *, key: Sequence[str], number: str = "round", most: int = 2) -> DataFrame:
    """The next round per owner: one more than the highest number or the count of rows, whichever is larger;
    ``escalate`` when that exceeds ``most``."""
    nxt = F.greatest(F.coalesce(F.max(number).cast("long"), F.lit(0)), F.count("*")) + 1
    return rounds.groupBy(*key).agg(nxt.alias("next_round")).withColumn("escalate", F.col("next_round") > most)


def work_queue(issues: DataFrame, rounds: DataFrame, dispatched: DataFrame, *, most: int = 2) -> DataFrame:
    """Pending owners with their agent (none for the manifest and pipeline), next round and escalation."""
    queue = pending(issues, rounds, include_done=True).join(next_round(rounds, key=["owner"], most=most), "owner", "left")
    agents = dispatched.groupBy("owner").agg(F.max_by("agent", F.struct("at", "agent")).alias("agent"))
    machine = F.col("owner").isin("manifest", "pipeline")
    return queue.join(agents, "owner", "left").withColumns({"next_round": F.coalesce("next_round", F.lit(1)), "escalate": F.coalesce("escalate", F.lit(False)), "agent": F.when(~machine, F.col("agent"))})


def marked(rounds: DataFrame, owner: str, result: str, *, number: int | None, agent: str | None, note: str, at: str) -> DataFrame:
    """Append one row to the ledger of rounds."""
    row = rounds.sparkSession.createDataFrame([(owner, result, number, agent, note, at)], "owner string, result string, round int, agent string, note string, at string")
    return rounds.unionByName(row, allowMissingColumns=True)


def ingested_findings(findings: DataFrame, owners: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Review findings split in accepted ones, with an owner by scope, and rejected ones with a reason."""
    scope = F.upper(F.trim("scope"))
    owner = F.coalesce("owner", F.create_map(*[F.lit(x) for kv in owners.items() for x in kv])[scope])
    reason = F.when(~F.coalesce(scope.rlike("^L[1-6]$"), F.lit(False)), "scope").when(F.coalesce(F.length(F.trim("what")), F.lit(0)) == 0, "what").when(owner.isNull(), "owner")
    checked = findings.withColumns({"owner": owner, "reason": reason})
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def once_only(work: DataFrame, stamps: DataFrame, *, stamp: Sequence[str]) -> DataFrame:
    """Work whose stamp has not been applied yet."""
    return work.join(stamps.select(*stamp).distinct(), list(stamp), "left_anti")


def remapped(refs: DataFrame, mapping: DataFrame, *, key: Sequence[str], ref: str, old: str, new: str) -> DataFrame:
    """Rewrite page references by a mapping; what it doesn't name is dangling and kept as it is."""
    out = refs.join(mapping.select(*key, F.col(old).alias(ref), F.col(new).alias("_new")), [*key, ref], "left")
    return out.withColumns({"dangling": F.col("_new").isNull(), ref: F.coalesce("_new", ref)}).drop("_new")


def digest_drift(recorded: DataFrame, current: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Recorded against current digests, by row: same, changed, missing now, or new."""
    both = recorded.select(*key, F.col("digest").alias("_was")).join(current.select(*key, F.col("digest").alias("_is")), list(key), "full")
    state = F.when(F.col("_was").isNull(), "new").when(F.col("_is").isNull(), "missing").when(F.col("_was") == F.col("_is"), "same").otherwise("changed")
    return both.select(*key, state.alias("state"))


def read_through(wanted: DataFrame, cache: DataFrame, *, key: Sequence[str], needed: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Cached rows that have all needed columns filled, and the wanted keys that have to be made."""
    whole = cache.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed], F.lit(True)))
    return wanted.join(whole, list(key)), wanted.join(whole.select(*key), list(key), "left_anti")


def stamped(chapters: DataFrame, ledger: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Copy the latest recorded digest into the chapters dispatched under it; ``top`` carries it only if all of
    a key's chapters are covered."""
    last = ledger.groupBy(*key).agg(F.max_by(F.struct("slideset_id", "chapters"), F.struct("at", "slideset_id")).alias("_l"))
    out = chapters.join(last, list(key), "left").withColumn("slideset_id", F.when(F.array_contains("_l.chapters", F.col("id")), F.col("_l.slideset_id")).otherwise(F.col("slideset_id")))
    top = out.groupBy(*key).agg(F.when(F.bool_and(F.array_contains("_l.chapters", F.col("id"))), F.first("_l.slideset_id")).alias("top"))
    return out.drop("_l").join(top, list(key))


def resolved_basis(tables: dict[str, DataFrame | None], basis: str) -> DataFrame:
    """The full or the sampled dataset, as asked; never silently the other one."""
    found = tables.get(basis)
    if found is None:
        raise ValueError(f"no dataset for basis {basis!r}; there are {sorted(k for k, v in tables.items() if v is not None)}")
    return found


def check_destination(basis: str, destination: str, expected: dict[str, str]) -> None:
    """Refuse to write one basis where another belongs."""
    if destination != expected[basis]:
        raise ValueError(f"{basis} results go to {expected[basis]}, not {destination}")


def snapshot(df: DataFrame, path: str, stamp: str) -> None:
    """Keep a copy under ``_history/<stamp>`` before overwriting."""
    df.write.mode("errorifexists").parquet(f"{path}/_history/{stamp}")


def clean(spark, root: str, levels: Sequence[str]) -> list[str]:
    """Delete the trees of the given levels under ``root``; returns those that were there."""
    jvm, gone = spark.sparkContext._jvm, []
    for level in levels:
        target = jvm.org.apache.hadoop.fs.Path(f"{root}/{level}")
        if target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True):
            gone.append(level)
    return gone
