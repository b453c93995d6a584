"""Caption formats as table functions: SRC-07, SRC-08 and any format that a user adds.

A format is a function from a text to cues, known by its name. ``register`` makes every known format a table function of the session, so that a
query says ``SELECT * FROM srt(TABLE(files), 'body')``: the input's columns but the text, then ``seq``, ``t_from``, ``t_to`` and ``text``.
``operators.markup`` has the same two formats as expressions, for pipelines that need no other; a format of one's own needs no
change there.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .artifacts import Registry

Cue = tuple[float, float, str]
FORMATS = Registry()
#: The forms of the two known formats.
SRT_TIMES = re.compile(r"(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})\s*-->\s*(\d{1,2}):(\d{2}):(\d{2})[,.](\d{1,3})")
JSON_LISTS, JSON_FROM, JSON_TO, JSON_TEXT = ("body", "segments"), ("from", "start"), ("to", "end"), ("content", "text")


def _seconds(h: str, m: str, s: str, fraction: str) -> float:
    return int(h) * 3600 + int(m) * 60 + int(s) + int(fraction.ljust(3, "0")) / 1000


@FORMATS.register("srt")
def srt(text: str) -> Iterator[Cue]:
    """Blocks divided by blank lines; what stands before a block's times is its number."""
    for block in re.split(r"\n[ \t]*\n", text.replace("\r", "")):
        if times := SRT_TIMES.search(block):
            lines = block[times.end() :].split("\n")[1:]
            yield _seconds(*times.groups()[:4]), _seconds(*times.groups()[4:]), " ".join(x.strip(" ") for x in lines if x.strip(" "))


@FORMATS.register("json_captions")
def json_captions(text: str) -> Iterator[Cue]:
    """A list of cues under any of the accepted names; a text that is no such JSON has none."""
    first = lambda cue, names: next((cue[n] for n in names if cue.get(n) is not None), None)
    try:
        held = json.loads(text)
    except ValueError:
        return
    for cue in (first(held, JSON_LISTS) if isinstance(held, dict) else None) or ():
        yield first(cue, JSON_FROM), first(cue, JSON_TO), (first(cue, JSON_TEXT) or "").strip(" ")


def table_function(parse: Callable[[str], Iterator[Cue]]):
    """A table function of a format: blank cues are dropped, the others numbered from 1; a null text has none."""

    class Cues:
        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument) -> AnalyzeResult:
            fields = [f for f in rows.dataType.fields if f.name != text.value]
            if len(fields) == len(rows.dataType.fields):
                raise ValueError(f"the table has no column {text.value!r}")
            made = StructType(fields)
            for name, kind in (("seq", IntegerType()), ("t_from", DoubleType()), ("t_to", DoubleType()), ("text", StringType())):
                made = made.add(name, kind)
            return AnalyzeResult(schema=made)

        def eval(self, rows: Row, text: str):
            others = [v for n, v in zip(rows.__fields__, rows, strict=True) if n != text]
            cues = (c for c in parse(rows[text]) if c[2]) if rows[text] is not None else ()
            for seq, (start, end, words) in enumerate(cues, 1):
                yield (*others, seq, None if start is None else float(start), None if end is None else float(end), words)

    return udtf(Cues)


def register(spark: SparkSession, formats: Registry = FORMATS) -> list[str]:
    """Every format of ``formats`` as a table function of the session; returns their names."""
    for name, parse in formats.known.items():
        spark.udtf.register(name, table_function(parse))
    return sorted(formats.known)
