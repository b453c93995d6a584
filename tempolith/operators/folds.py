"""Sequential decisions, where each depends on what the ones before decided. One pass over each key's rows, in order.

WIN-04 to WIN-06, WIN-07 (span cap and short merge), WIN-08, WIN-12, WIN-13, WIN-15, WIN-19, WIN-25, J-01.
A key's rows are folded in one task where keys are entities (one recording, one conversation). ``greedy_chunks``, ``paragraphs`` and
``spaced_picks`` take ``rows_per_range`` for keys of any size: their state is then carried from range to range (``ranges``).
Null keys form one group; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .ranges import Step, fold_in_ranges, running


def fold(df: DataFrame, *, key: Sequence[str], order: Sequence[str], columns: Sequence[str], step: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``step`` to each key's rows in order; ``schema`` names the columns after the keys.

    Rows are dealt by key and sorted by Spark; a task cuts its batches where the key changes, so that small keys cost a slice each and
    not an exchange with Python each. Columns of other than plain types take Spark's own grouping.
    """
    chosen = df.select(*dict.fromkeys([*key, *order, *columns]))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
    if not set(kind for _, kind in chosen.dtypes) <= PLAIN:

        def run(names, rows: pd.DataFrame) -> pd.DataFrame:
            out = step(rows.sort_values(list(order), kind="stable").reset_index(drop=True))
            for place, (k, v) in enumerate(zip(key, names, strict=True)):
                out.insert(place, k, v)
            return out

        return chosen.groupBy(*key).applyInPandas(run, f"{kinds}, {schema}")

    shape = T.StructType([df.schema[k] for k in key] + T.StructType.fromDDL(schema).fields)
    target = to_arrow_schema(shape)
    integers = [c for c, kind in chosen.dtypes if kind in INTEGERS]
    floats = [k for k, kind in chosen.dtypes if kind in ("float", "double") and k in key]

    def folded(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """All keys of ``table``, whole."""
        whole = table.to_pandas(integer_object_nulls=True, date_as_object=True)
        gappy = [c for c in integers if table.column(c).null_count]
        begins = _begins(table, key, floats)
        ends = [*begins[1:], table.num_rows]
        made = []
        for begin, end in zip(begins, ends, strict=True):
            rows = whole.iloc[begin:end].reset_index(drop=True)
            for c in gappy:  # as each key's rows by themselves would come
                rows[c] = rows[c].astype("float64" if rows[c].isna().any() else whole_kind[c])
            made.append(step(rows))
        values = pd.concat(made, ignore_index=True)
        again = pa.array(np.repeat(begins, [len(x) for x in made]), pa.int64())
        parts = [table.column(k).take(again) for k in key] + [pa.chunked_array([pa.Array.from_pandas(values[f.name], type=f.type)]) for f in list(target)[len(key) :]]
        yield from pa.Table.from_arrays([p.cast(f.type) for p, f in zip(parts, target, strict=True)], schema=target).to_batches(max_chunksize=10_000)

    whole_kind = {c: INTEGERS[kind] for c, kind in chosen.dtypes if kind in INTEGERS}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            if held and len(_begins(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch]), key, floats)) == 1:
                held.append(batch)
                continue
            table = pa.Table.from_batches([*held, batch])
            last = _begins(table, key, floats)[-1]
            if last:
                yield from folded(table.slice(0, last))
            held = table.slice(last).to_batches()
        if held:
            yield from folded(pa.Table.from_batches(held))

    dealt = chosen.repartition(*key).sortWithinPartitions(*(F.asc_nulls_first(k) for k in key), *(F.asc_nulls_last(c) for c in order))
    return dealt.mapInArrow(run, shape)


#: Column types whose rows look alike whether they come by key or by batch, and pandas' names of integers.
INTEGERS = {"tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64"}
PLAIN = {*INTEGERS, "float", "double", "string", "boolean"}


def _begins(table: pa.Table, key: Sequence[str], floats: Sequence[str]) -> list[int]:
    """Where another key begins than in the row before; nulls are equal, and so are NaNs and both zeros."""
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in key:
        column = table.column(k).combine_chunks()
        empty = column.is_null().to_numpy(zero_copy_only=False)
        changed = pc.fill_null(pc.not_equal(column.slice(1), column.slice(0, n - 1)), False).to_numpy(zero_copy_only=False)
        if k in floats:
            nan = pc.fill_null(pc.is_nan(column), False).to_numpy(zero_copy_only=False)
            changed = changed & ~(nan[1:] & nan[:-1])
        new[1:] |= changed | (empty[1:] != empty[:-1])
    return np.flatnonzero(new).tolist()


def carried(df: DataFrame, *, key: Sequence[str], order: Sequence[str], columns: Sequence[str], step: Step, schema: str, rows_per_range: int | None) -> DataFrame:
    """A fold whose ``step`` goes on from a state: a key in one task, or in ranges of ``rows_per_range`` rows (with ``_range``)."""
    if rows_per_range is None:
        return fold(df, key=key, order=order, columns=columns, step=lambda rows: step(rows, None, True)[0], schema=schema)
    return fold_in_ranges(df, key=key, order=order, columns=columns, step=step, schema=schema, rows_per_range=rows_per_range)


def greedy_chunks(df: DataFrame, *, key: Sequence[str], order: Sequence[str], size: str, cap: int, rows_per_range: int | None = None) -> DataFrame:
    """Pack rows in order: a chunk is closed when the next row would exceed ``cap`` and it is at least half full."""

    def step(rows: pd.DataFrame, filled, final: bool):
        opens = []
        for n in rows[size]:
            first = filled is None or filled + n > cap and filled >= cap / 2
            filled = int(n) + (0 if first else filled)
            opens.append(int(first))
        return rows[list(order)].assign(chunk=opens), filled

    def whole(rows: pd.DataFrame, filled, final: bool):
        out, filled = step(rows, filled, final)
        return out.assign(chunk=out["chunk"].cumsum()), filled

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    out = carried(df, key=key, order=order, columns=[size], step=step if rows_per_range else whole, schema=f"{kinds}, chunk int", rows_per_range=rows_per_range)
    if rows_per_range is None:
        return out
    opened = running(out.withColumnRenamed("chunk", "_opens"), key=key, order=order, value=F.col("_opens"), out="chunk")
    return opened.drop("_opens").withColumn("chunk", F.col("chunk").cast("int"))


def paragraphs(
    df: DataFrame, *, key: Sequence[str], order: str, start: str, end: str, text: str, gap: float = 1.2, span: float = 120.0, short: int = 30, rows_per_range: int | None = None
) -> DataFrame:
    """Cues to paragraphs: a new one after a pause (in whole seconds) of at least ``gap`` or beyond ``span``
    seconds; then those under ``short`` characters join the one before. The first is never joined."""

    def step(rows: pd.DataFrame, state, final: bool):
        kept, made = state or (None, None)  # the last paragraph, to which short ones may still be joined, and the one that grows
        done: list[list] = []

        def closed() -> None:
            nonlocal kept
            if kept and len("".join(made[4].split())) < short:
                kept = [kept[0], made[1], kept[2], made[3], kept[4] + made[4]]
            else:
                done.extend([kept] if kept else [])
                kept = made

        for seq, a, b, words in zip(rows[order].tolist(), rows[start], rows[end], rows[text].fillna(""), strict=True):
            a, b = int(a), int(b)
            if made and a - made[1] < gap and b - made[0] <= span:
                made = [made[0], b, made[2], seq, made[4] + words]
            else:
                if made:
                    closed()
                made = [a, b, seq, seq, words]
        if final:
            closed()
            done.append(kept)
        out = pd.DataFrame(done, columns=["t_start", "t_end", "seg_from", "seg_to", "text"])
        out.insert(0, "id", range(1, len(out) + 1))
        out["chars"] = [len("".join(t.split())) for t in out["text"]]
        return out, (kept, made)

    kind = df.schema[order].dataType.simpleString()
    schema = f"id int, t_start int, t_end int, seg_from {kind}, seg_to {kind}, text string, chars int"
    out = carried(df, key=key, order=[order], columns=[start, end, text], step=step, schema=schema, rows_per_range=rows_per_range)
    if rows_per_range is None:
        return out
    numbers = running(out.drop("id"), key=key, order=["seg_from"], value=F.lit(1), out="id").withColumn("id", F.col("id").cast("int"))
    return numbers.select(*key, "id", "t_start", "t_end", "seg_from", "seg_to", "text", "chars")


def spaced_picks(df: DataFrame, *, key: Sequence[str], time: str, tie: Sequence[str], value: str, threshold: float, apart: float, rows_per_range: int | None = None) -> DataFrame:
    """Rows whose value exceeds ``threshold``, at least ``apart`` after the last pick. The first row is picked."""
    order = [time, *tie]

    def step(rows: pd.DataFrame, last, final: bool):
        picks = []
        for k, (t, v) in enumerate(zip(rows[time].tolist(), rows[value], strict=True)):
            if last is None or (v is not None and v > threshold and t - last >= apart):
                picks.append(k)
                last = t
        return rows.loc[picks, order], last

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    out = carried(df, key=key, order=order, columns=[value], step=step, schema=kinds, rows_per_range=rows_per_range)
    return out if rows_per_range is None else out.drop("_range")


def greedy_distinct_hashes(df: DataFrame, *, key: Sequence[str], order: Sequence[str], hashed: str, limit: int = 6, most: int | None = None) -> DataFrame:
    """Keep rows whose 64-bit hash differs from every kept one in more than ``limit`` bits. With ``most`` the
    rest is reported as skipped; nothing else is dropped."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        kept, marks = [], []
        for h in rows[hashed]:
            h = int(h) & ((1 << 64) - 1)
            twin = any((h ^ k).bit_count() <= limit for k in kept)
            full = most is not None and len(kept) >= most
            marks.append("duplicate" if twin else "over limit" if full else "kept")
            if not twin and not full:
                kept.append(h)
        return rows[list(order)].assign(verdict=marks)

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    return fold(df, key=key, order=order, columns=[hashed], step=step, schema=f"{kinds}, verdict string")


def proportional_ranges(df: DataFrame, *, key: Sequence[str], order: Sequence[str], anchor: str, weight: str, start: str, end: str, least: int = 30) -> DataFrame:
    """Contiguous whole-second ranges for ordered sections. A section whose anchor is more than a second after
    the previous anchor opens a group; a group lasts to the next usable anchor, and its sections share it in
    proportion to their weights (``least`` at least), each one second at least and the last up to the end."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        anchors = [None if pd.isna(a) else int(a) for a in rows[anchor]]
        limit, reached = int(rows[end].iloc[0]), int(rows[start].iloc[0])
        heads = [0] + [k for k in range(1, len(rows)) if anchors[k] is not None and (anchors[k - 1] is None or anchors[k] > anchors[k - 1] + 1)]
        spans: list[tuple[int, int]] = []
        for g, head in enumerate(heads):
            members = range(head, heads[g + 1] if g + 1 < len(heads) else len(rows))
            first = anchors[head] if anchors[head] is not None and anchors[head] >= reached else reached
            later = (anchors[h] for h in heads[g + 1 :] if anchors[h] > first + 1)
            last = max(min(next(later, limit), limit), first + 1)
            weights = [max(int(w or 0), least) for w in rows[weight].iloc[list(members)]]
            at = first
            for k, w in enumerate(weights):
                to = last if k + 1 == len(weights) else at + max(1, round((last - first) * w / sum(weights)))
                to = min(max(to, at + 1), max(last, at))
                spans.append((at, to))
                at = to
            reached = last
        return rows[list(order)].assign(range_from=[a for a, _ in spans], range_to=[b for _, b in spans])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in order)
    return fold(df, key=key, order=order, columns=[anchor, weight, start, end], step=step, schema=f"{kinds}, range_from int, range_to int")


def character_containment(a: str, b: str) -> float:
    """Shared characters, counted with repeats, over the shorter text's length."""
    return sum((Counter(a) & Counter(b)).values()) / min(len(a), len(b)) if a and b else 0.0


def gram_containment(a: str, b: str, n: int = 4) -> float:
    ga, gb = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
    return len(ga & gb) / min(len(ga), len(gb)) if ga and gb else 0.0


def _plain(text: str | None) -> str:
    return "".join(c for c in (text or "") if c.isascii() and c.isalnum() or "一" <= c <= "鿿").lower()


def merge_pages(
    df: DataFrame, *, key: Sequence[str], hash_limit: int = 6, gram_least: float = 0.45, chars_least: int = 16, span: float = 240.0, thin_chars: int = 20, thin_sec: float = 60.0, thin_contain: float = 0.5
) -> DataFrame:
    """Segments (id, t_start, t_end, n_frames, score, dhash, text) of the same page become one.

    First neighbours merge while they look alike (hash) or read alike (4-grams) and together stay within
    ``span``; the better scored one's face survives. Then a thin segment (little text, short) is absorbed by
    the surviving one before it or the one after it, if that one's text has the thin one's characters.
    """

    def reason(a: dict, b: dict) -> str:
        if ((int(a["dhash"]) ^ int(b["dhash"])) & ((1 << 64) - 1)).bit_count() <= hash_limit:
            return "hash"
        ta, tb = _plain(a["text"]), _plain(b["text"])
        return "gram" if min(len(ta), len(tb)) >= chars_least and gram_containment(ta, tb) >= gram_least else ""

    def widened(into: dict, other: dict, why: str) -> None:
        into["t_start"], into["t_end"] = min(into["t_start"], other["t_start"]), max(into["t_end"], other["t_end"])
        into["n_frames"] += other["n_frames"]
        into["merged_from"] = [*into["merged_from"], other["id"], *other["merged_from"]]
        into["merge_reason"] = into["merge_reason"] if why == "absorb-thin" and into["merge_reason"] else why

    def extent(a: dict, b: dict) -> float:
        return max(a["t_end"], b["t_end"]) - min(a["t_start"], b["t_start"])

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        survivors: list[dict] = []
        for row in rows.to_dict("records"):
            row |= {"merged_from": [], "merge_reason": "", "text": row["text"] or ""}
            why = reason(survivors[-1], row) if survivors and extent(survivors[-1], row) <= span else ""
            if not why:
                survivors.append(row)
            elif row["score"] > survivors[-1]["score"]:
                widened(row, survivors[-1], why)
                survivors[-1] = row
            else:
                widened(survivors[-1], row, why)
        final: list[dict] = []
        for k, row in enumerate(survivors):
            host = None
            if len(row["text"]) < thin_chars and row["t_end"] - row["t_start"] <= thin_sec:
                around = [*final[-1:], *survivors[k + 1 : k + 2]]
                host = next((c for c in around if len(c["text"]) >= thin_chars and character_containment(_plain(row["text"]), _plain(c["text"])) >= thin_contain and extent(row, c) <= span), None)
            if host is None:
                final.append(row)
            else:
                frames = host["n_frames"]
                widened(host, row, "absorb-thin")
                host["n_frames"] = frames
        out = pd.DataFrame(final, columns=["id", "t_start", "t_end", "n_frames", "score", "dhash", "text", "merged_from", "merge_reason"])
        out["source_id"] = out["id"]
        out["id"] = range(1, len(out) + 1)
        return out[["id", "source_id", "t_start", "t_end", "n_frames", "score", "dhash", "text", "merged_from", "merge_reason"]]

    schema = "id int, source_id int, t_start double, t_end double, n_frames int, score double, dhash long, text string, merged_from array<int>, merge_reason string"
    return fold(df, key=key, order=["t_start", "id"], columns=["t_end", "n_frames", "score", "dhash", "text"], step=step, schema=schema)


def segment_axis(df: DataFrame, *, key: Sequence[str], fps: float, diff_limit: float = 0.035, stable_sec: float = 1.5, look_back_sec: float = 1.5, percentile: float = 0.85, multiple: float = 3.0, least_sec: float = 4.0) -> DataFrame:
    """Cut each key's frames (i, diff) into segments: runs of small differences that follow a hard cut within
    ``look_back_sec`` begin segments (all runs do, if none follows one); the axis starts at the first frame;
    pieces under ``least_sec`` join the one before. Returns id, i_start, i_end (first of the next)."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        d, n = rows["diff"].astype(float), len(rows)
        cut = (d >= max(d.quantile(percentile), d.mean() * multiple)).tolist() if n >= 8 else [False] * n
        small = [False, *(d.iloc[1:] <= diff_limit).tolist()]
        runs, k = [], 1
        while k < n:
            if small[k]:
                first = k - 1
                while k < n and small[k]:
                    k += 1
                if (k - 1 - first) / fps >= stable_sec:
                    runs.append(first)
            else:
                k += 1
        back = int(look_back_sec * fps)
        starts = [r for r in runs if any(cut[max(0, r - back) : r + 1])] or runs
        edges = sorted({0, *starts})
        kept = [edges[0]]
        bounds = [*edges[1:], n]
        for a, b in zip(edges[1:], bounds[1:], strict=True):
            if (b - a) / fps >= least_sec:
                kept.append(a)
        return pd.DataFrame({"id": range(1, len(kept) + 1), "i_start": kept, "i_end": [*kept[1:], n]})

    return fold(df, key=key, order=["i"], columns=["diff"], step=step, schema="id int, i_start int, i_end int")


def chapters_of_groups(groups: DataFrame, slides: DataFrame, durations: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Groups (ord, slides) to chapters: unknown slides and empty groups are dropped, a chapter ends where the
    next begins, the last one at the duration."""
    named = groups.select(*key, "ord", F.explode("slides").alias("id")).join(slides.select(*key, "id", "t_start"), [*key, "id"])
    made = named.groupBy(*key, "ord").agg(F.min("t_start").alias("t_start"), F.array_sort(F.collect_set("id")).alias("slides"))
    w = Window.partitionBy(*key).orderBy("t_start", "ord")
    numbered = made.join(durations, list(key), "left").withColumns({"n": F.row_number().over(w), "t_end": F.coalesce(F.lead("t_start").over(w), "duration")})
    return numbered.select(*key, F.lpad(F.col("n").cast("string"), 2, "0").alias("id"), "t_start", "t_end", "slides")


def grid_components(df: DataFrame, *, key: Sequence[str], row: str, col: str) -> DataFrame:
    """Label 4-connected cells of each key's (bounded) grid with the smallest cell of their component."""

    def step(rows: pd.DataFrame) -> pd.DataFrame:
        cells = set(zip(rows[row], rows[col], strict=True))
        label: dict = {}
        for cell in sorted(cells):
            if cell in label:
                continue
            queue = [cell]
            while queue:
                r, c = queue.pop()
                if (r, c) in label or (r, c) not in cells:
                    continue
                label[(r, c)] = cell
                queue += [(r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)]
        return pd.DataFrame([(r, c, f"{label[(r, c)][0]}-{label[(r, c)][1]}") for r, c in sorted(cells)], columns=[row, col, "component"])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in (row, col))
    return fold(df, key=key, order=[row, col], columns=[], step=step, schema=f"{kinds}, component string")
