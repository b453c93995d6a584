"""Tables of artifacts with explicit schemas, readers, sinks and the operator registry.

SRC-15, SRC-20, SRC-22, SRC-23, SNK-01, NST-01, NST-03, NST-04, NST-07, ORC-02, ORC-20, ORC-34. What another system makes (downloads, decoded frames,
recognised speech and text) enters as these tables.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "meta": "vid STRING, bvid STRING, page INT, title STRING, part STRING, cid BIGINT, duration DOUBLE, page_count INT, owner STRING, pubdate BIGINT, tname STRING, tid INT, `desc` STRING, aid BIGINT, top_comment STRUCT<user: STRING, text: STRING, likes: BIGINT>, tags ARRAY<STRING>, url STRING, all_parts ARRAY<STRUCT<page: INT, cid: BIGINT, part: STRING, duration: DOUBLE>>",
    "transcript": "vid STRING, seq INT, t_from DOUBLE, t_to DOUBLE, text STRING",
    "transcript_header": "vid STRING, backend STRING, language STRING, source STRING, coverage DOUBLE, partial BOOLEAN, fetched_at STRING",
    "frames": "vid STRING, i INT, file STRING, t DOUBLE, dhash BIGINT, ink DOUBLE, sharp DOUBLE, diff DOUBLE",
    "frame_metrics": "vid STRING, line_no INT, line STRING",
    "measure_buckets": "vid STRING, s INT, motion DOUBLE, motion_max DOUBLE, cut_score DOUBLE, n INT",
    "measure_events": "vid STRING, kind STRING, t_from DOUBLE, t_to DOUBLE, dur DOUBLE, score DOUBLE",
    "overlay_regions": "vid STRING, ord INT, kind STRING, box ARRAY<DOUBLE>, confidence DOUBLE, applicability STRING, frames ARRAY<STRING>, evidence STRING",
    "slides": "vid STRING, id INT, t_start DOUBLE, t_end DOUBLE, frame STRING, chosen_t DOUBLE, sha256 STRING, ocr_chars INT, ocr_text STRING, role STRING, merged_from ARRAY<INT>",
    "sample_sections": "vid STRING, window INT, orig_from DOUBLE, orig_to DOUBLE, media_from DOUBLE, media_to DOUBLE",
    "paragraphs": "vid STRING, id INT, t_start INT, t_end INT, seg_from INT, seg_to INT, chars INT, text STRING",
    "chunks": "vid STRING, no INT, para_from INT, para_to INT, t_start INT, t_end INT, chars INT",
    "chapters": "vid STRING, id STRING, title STRING, range ARRAY<STRING>, slides ARRAY<INT>, body STRING, keypoints ARRAY<STRING>, questions ARRAY<STRING>, corrections ARRAY<STRUCT<wrong: STRING, right: STRING, evidence: STRING, basis: STRING>>, uncertainties ARRAY<STRING>, review_flags ARRAY<STRING>, coverage_notes STRING, stage_merges ARRAY<STRUCT<slides: ARRAY<INT>, kept: INT, why: STRING>>, slideset_id STRING",
    "patches": "vid STRING, patch_file STRING, id STRING, title STRING, keypoints ARRAY<STRING>, questions ARRAY<STRING>, uncertainties ARRAY<STRING>, review_flags ARRAY<STRING>, coverage_notes STRING",
    "issues": "vid STRING, level STRING, owner STRING, chapter STRING, file STRING, message STRING, fix_hint STRING, scope STRING, severity STRING",
    "rounds": "vid STRING, owner STRING, result STRING, round INT, agent STRING, note STRING, at STRING",
    "glossary": "vid STRING, confirmed BOOLEAN, terms_use ARRAY<STRING>, terms_avoid MAP<STRING, STRING>, auto_avoid MAP<STRING, STRING>",
    "sheet_tiles": "vid STRING, idx INT, sheet STRING, tile_row INT, tile_col INT, t DOUBLE, frame STRING, sha256 STRING, window INT",
}


def read_json(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """An artifact table from JSON: explicit schema, missing fields null, unreadable rows kept as nulls."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "PERMISSIVE").option("multiLine", "true").json(path)


def read_texts(spark: SparkSession, path: str, pattern: str = "0*.md") -> DataFrame:
    """(path, text) of whole files in name order of their paths."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", pattern).text(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).orderBy("path")


def read_media(spark: SparkSession, path: str, priority: tuple[str, ...] = ("mp4", "mkv", "webm", "m4a", "mp3", "wav")) -> DataFrame:
    """The first file of a folder by extension, then name: (path, length); contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select("path", "length")
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    rank = F.array_position(F.array(*map(F.lit, priority)), suffix)
    return files.where(rank > 0).orderBy(rank, "path").limit(1)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_partitioned(df: DataFrame, path: str, key: str = "vid") -> None:
    """One folder per key: what a file per entity is for one machine."""
    df.write.mode("overwrite").partitionBy(key).parquet(path)


def by_key(items: Column, key: str) -> Column:
    """An array of structs as a map by one of their fields."""
    return F.map_from_entries(F.transform(items, lambda x: F.struct(x[key], x)))


def regions_split(regions: DataFrame, *, key: list[str]) -> DataFrame:
    """Per key the boxes that hold on every frame, the per-frame files, and whether handwriting was found."""
    ok = F.col("applicability") == "ok"
    return regions.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.when(ok & ~F.col("kind").isin("transient_overlay", "handwriting"), F.col("box")))).alias("boxes"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.when(ok & (F.col("kind") == "transient_overlay"), F.col("frames")))))).alias("frames"),
        F.coalesce(F.bool_or(ok & (F.col("kind") == "handwriting")), F.lit(False)).alias("strokes"),
    )


def episode(meta: DataFrame, *others: DataFrame, key: str = "vid") -> DataFrame:
    """One row per entity from its optional artifacts; what is absent stays null."""
    out = meta
    for df in others:
        out = out.join(df, key, "left")
    return out


@dataclass(frozen=True)
class Settings:
    """Parameters by section; the documented defaults."""

    values: Mapping[str, Mapping[str, object]] = field(default_factory=dict)

    def section(self, name: str, kind: type):
        """The section as a dataclass of ``kind``: unknown names are ignored, values take the defaults' types."""
        given, default = self.values.get(name, {}), kind()
        return replace(default, **{f.name: coerced(given[f.name], getattr(default, f.name)) for f in fields(kind) if f.name in given})


def coerced(value: object, like: object) -> object:
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, (int, float)) and not isinstance(value, bool):
        return type(like)(value)
    if isinstance(like, tuple) and isinstance(value, str):
        return tuple(x.strip() for x in value.split(",") if x.strip())
    return value


def merged(*layers: Mapping) -> dict:
    """Nested maps over one another, later ones winning."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merged(out.get(k, {}), v) if isinstance(v, Mapping) and isinstance(out.get(k, {}), Mapping) else v
    return out


def from_environment(prefix: str, environment: Mapping[str, str] = os.environ) -> dict:
    """``PREFIX_SECTION_KEY`` variables as nested values."""
    out: dict = {}
    for name, value in environment.items():
        if name.startswith(prefix + "_") and name.count("_") >= 2:
            section, _, key = name[len(prefix) + 1 :].lower().partition("_")
            out.setdefault(section, {})[key] = value
    return out


class Registry:
    """Named strategies: a name to a function of a session and parameters."""

    def __init__(self):
        self.known: dict[str, Callable[..., DataFrame]] = {}

    def register(self, name: str):
        def add(f):
            if name in self.known:
                raise ValueError(f"{name} is registered already")
            self.known[name] = f
            return f

        return add

    def run(self, name: str, *args, existing: DataFrame | None = None, force: bool = False, **params) -> DataFrame:
        """The strategy's result; an existing one is taken as it is unless forced."""
        if existing is not None and not force:
            return existing
        if name not in self.known:
            raise KeyError(f"no strategy {name!r}; there are {sorted(self.known)}")
        return self.known[name](*args, **params)
