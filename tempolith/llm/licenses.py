"""License scan by ordered signature rules.

A text is lower-cased (A-Z) and reduced to its words; rules are regular expressions over the words joined
by single blanks: the hand-written ones of ``signatures``, and after them, with less priority, names of licenses in the
usual frames. Each rule is gated by a keyword that any match must contain as a word or, before versions, as a word's beginning; one Aho-Corasick pass over
the text finds which keywords occur, and only their rules are run. Detections are then resolved: one that
lies inside another is suppressed if the other's rule has a higher priority, or the same and comes first or
is longer. The base phrases are rules of the highest priority and are never suppressed. Rules of whole SPDX expressions
suppress nothing: every license of an expression keeps its label. Where a license's name is a common word (boost, elastic,
python), "license" before it doesn't tell, a version or "license" after it does. A name alone (ISC, MIT) is none, an SPDX form with its version is.

Null and empty texts have no words and no detections. Whole texts are scanned; repeated rows get equal
results; an empty table gives an empty one. Other columns pass through; those with a result's name get ``_input`` after theirs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import signatures, store

#: Bytes of words stay, A-Z in lower case; every other byte becomes a blank. Bytes over 0x7F are in words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isdigit() or 97 <= c <= 122 else 32 for c in range(256))

#: The phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

BASE_PRIORITY, GRANT, NAMED, TAGGED, LINKED, HINTED = 100, 80, 60, 50, 40, 20


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str
    prefix: bool = False  # the keyword only begins a word, as in gplv3
    hides: bool = True  # whether it suppresses what lies inside its match


#: Families by name: label, and the names.
_FAMILIES = [
    ("mit", r"mit|expat|mit x"),
    ("x11", r"x consortium"),
    ("bsd", r"bsd|berkeley software distribution|new bsd|modified bsd|simplified bsd|freebsd|revised bsd"),
    ("apache", r"apache|apache software|asl"),
    ("gpl", r"gpl|gnu gpl"),
    ("gpl", r"gnu public|gnu copyleft"),
    ("lgpl", r"lgpl|gnu lgpl"),
    ("lgpl", r"gnu lesser general public|lesser general public"),
    ("lgpl", r"gnu library general public|library general public"),
    ("agpl", r"agpl|gnu agpl"),
    ("agpl", r"gnu affero general public|affero general public|affero gpl"),
    ("gfdl", r"gfdl|gnu fdl"),
    ("gfdl", r"gnu free documentation|free documentation"),
    ("mpl", r"mpl"),
    ("mpl", r"mozilla public|mozilla"),
    ("epl", r"eclipse public|eclipse distribution|eclipse"),
    ("cddl", r"cddl"),
    ("cddl", r"common development and distribution"),
    ("cpl", r"common public|ibm public"),
    ("isc", r"isc|openbsd isc"),
    ("zlib", r"zlib|zlib libpng"),
    ("libpng", r"libpng"),
    ("boost", r"boost software|boost"),
    ("unlicense", r"unlicense|the unlicense"),
    ("wtfpl", r"wtfpl"),
    ("artistic", r"artistic|perl artistic|clarified artistic"),
    ("psf", r"python software foundation|python|psf"),
    ("php", r"php"),
    ("ruby", r"ruby"),
    ("openssl", r"openssl|ssleay"),
    ("ofl", r"sil open font|open font"),
    ("eupl", r"european union public"),
    ("eupl", r"eupl"),
    ("cecill", r"cecill|cecill b|cecill c"),
    ("ms-pl", r"microsoft public|microsoft reciprocal"),
    ("afl", r"academic free"),
    ("osl", r"open software"),
    ("qpl", r"q public|qt public|qpl"),
    ("sleepycat", r"sleepycat"),
    ("vim", r"vim"),
    ("postgresql", r"postgresql"),
    ("ncsa", r"university of illinois ncsa|university of illinois"),
    ("mulan", r"mulan permissive software|mulan psl"),
    ("upl", r"universal permissive"),
    ("bsl", r"business source"),
    ("sspl", r"server side public"),
    ("elastic", r"elastic"),
    ("odbl", r"odbl"),
    ("odc-by", r"open data commons attribution|odc attribution"),
    ("cc0", r"cc0|cc zero|creative commons zero|publicdomain zero"),
]
#: Names that versions follow, within the word or after it: GPLv3, LGPLv2.1, GPL v3, AGPL version 3, MPL-2.0.
_VERSIONED = ["gpl", "lgpl", "agpl", "mpl"]
_VERSION = r"(?: ?v(?:ersion)?)? ?[0-9]+(?: [0-9]+)?"
#: How a family is named: how much that says, and what stands around the name.
_NAMINGS = [
    (GRANT, r"(?:licensed|released|distributed|available|published|provided) under (?:the |a |an )?(?:terms of )?(?:the )?{0} (?:style )?licen[sc]e"),
    (NAMED, r"(?:licensed|released|distributed|available|published|provided) under (?:the |a |an )?(?:terms of )?(?:the )?{0}"),
    (NAMED, r"{0} licen[sc]ed?(?: version)?"),
    (TAGGED, r"spdx license identifier {0}"),
    (TAGGED, r"licen[sc]e {0}"),
    (LINKED, r"(?:opensource org licen[sc]es?|choosealicense com licen[sc]es|spdx org licen[sc]es) {0}"),
]
#: Names that are common words, and the frame that tells them only with something behind.
_COMMON_NAMES = {"boost", "eclipse", "elastic", "mozilla", "artistic", "python", "php", "ruby", "vim", "open software", "open font", "common public", "academic free"}
_OPEN_FRAME, _CLOSED_FRAME = r"licen[sc]e {0}", r"licen[sc]e {0} (?:(?:public |software )?licen[sc]e|v(?:ersion)? ?[0-9]+|[0-9]+)"
#: SPDX forms that are also a product's version, a score or a sum.
_UNTOLD = {"mit 0", r"php 3 0[01]?", "elastic 2 0", r"epl [12] 0", r"artistic [12] 0", "psf 2 0", "upl 1 0", "bsl 1 0"}
#: Addresses of licenses, as the words that they come to. Fixed values.
_ADDRESSES = [
    ("gpl", r"gnu org (?:licenses|copyleft) (?:old licenses )?(?:gpl|gplv[123])(?: [123] 0)?"),
    ("lgpl", r"gnu org (?:licenses|copyleft) (?:old licenses )?(?:lgpl|lgplv[23])(?: [23] [01])?"),
    ("agpl", r"gnu org licenses agpl(?: 3 0)?"),
    ("gfdl", r"gnu org (?:licenses|copyleft) (?:old licenses )?fdl(?: 1 [123])?"),
    ("apache", r"apache org licenses(?: license [12] [01])?"),
    ("mpl", r"mozilla org (?:en us )?mpl(?: [12] [01])?"),
    ("epl", r"eclipse org (?:legal|org documents) epl(?: v10| v20| 2 0)?"),
    ("boost", r"boost org license 1 0"),
    ("ofl", r"scripts sil org ofl"),
    ("unlicense", r"unlicense org"),
    ("wtfpl", r"wtfpl net"),
    ("odbl", r"opendatacommons org licenses odbl"),
    ("odc-by", r"opendatacommons org licenses by"),
    ("pddl", r"opendatacommons org licenses pddl"),
    ("artistic", r"dev perl org licenses artistic"),
    ("psf", r"docs python org (?:3 )?license"),
    ("php", r"php net license"),
]
#: Creative Commons: the label's elements and their words.
_COMMONS = {
    "cc-by": r"attribution",
    "cc-by-sa": r"attribution share ?alike",
    "cc-by-nd": r"attribution no ?deriv(?:ative|ative works|atives|s)",
    "cc-by-nc": r"attribution non ?commercial",
    "cc-by-nc-sa": r"attribution non ?commercial share ?alike",
    "cc-by-nc-nd": r"attribution non ?commercial no ?deriv(?:ative|ative works|atives|s)",
}


#: Words that say little, taken as a gate only if a pattern has no other.
_PLAIN = {"a", "of", "is", "for", "and", "or", "to", "in", "that", "you", "may", "with", "without", "under", "identifier", "license", "licensed", "public", "general", "software", "the", "this", "distributed"}


def keyword_of(pattern: str) -> str:
    """The longest telling word that every match of ``pattern`` holds as a whole: no group, class or option
    touches it."""
    blank = lambda m: (" " if m[1][:1] == " " else "") + "?" + (" " if m[1][-1:] == " " else "")
    fixed = re.sub(r"\(\?:((?:[^()]|\([^()]*\))*)\)(?:[?*+]|\{[\d,]*\})?", blank, pattern)
    fixed = re.sub(r"[^ ]+ \?[^ ]+", "?", fixed)  # the blank between may be missing
    return max((w for w in fixed.split(" ") if re.fullmatch("[a-z\x80-\xff][a-z0-9\x80-\xff]*", w)), key=lambda w: (w not in _PLAIN, len(w), w))


def _rules() -> list[Rule]:
    made = [(label, BASE_PRIORITY, phrase) for phrase, label in BASE.items()]
    made += [(label, GRANT, pattern.encode().decode("latin-1")) for label, pattern in signatures.GRANTS]  # a character for each byte
    made += [(label, GRANT, rf"spdx license identifier {name}") for label, name in signatures.SPDX if label not in signatures.COMPOSED]
    made += [(label, TAGGED, name) for label, name in signatures.SPDX if label not in signatures.COMPOSED and " " in name and name not in _UNTOLD]
    made += [(label, LINKED, address) for label, address in _ADDRESSES]
    for label, names in _FAMILIES:
        for name in names.split("|"):
            frames = [(priority, _CLOSED_FRAME if around == _OPEN_FRAME and name in _COMMON_NAMES else around) for priority, around in _NAMINGS]
            made += [(label, priority, around.format(name)) for priority, around in frames]
    made += [("cc0", NAMED, r"cc0"), ("cc0", LINKED, r"publicdomain zero")]
    for label, words in sorted(_COMMONS.items(), key=lambda x: -len(x[0])):
        short = label[3:].replace("-", " ")
        made += [
            (label, GRANT, rf"(?:licensed|released|available|published) under (?:the |a )?creative commons {words}"),
            (label, NAMED, rf"creative commons {words}(?: licen[sc]e)?"),
            (label, NAMED, rf"cc {short}"),
            (label, LINKED, rf"creativecommons org licenses {short}"),
        ]
    made += [("cc", HINTED, r"creative commons"), ("licensed", HINTED, r"licensed (?:under|to|by)")]
    versions = [Rule(name, priority, name, around.format(name + _VERSION), True) for name in _VERSIONED for priority, around in _NAMINGS]
    member = "|".join(name for label, name in signatures.SPDX if label not in signatures.COMPOSED)
    one = rf"(?:{member})(?: with (?:[a-z]+ ){{1,4}}(?:exception|note)(?: [0-9] [0-9])?)?"
    tag = "spdx license identifier"
    later = [(label, rf"{tag} (?:{one} (?:or|and) ){{1,8}}{name}") for label, name in signatures.SPDX]
    later.append(("dual", rf"{tag} (?:{one} (?:or|and) ){{0,7}}{one} or (?:{member})"))
    composed = [(label, rf"{tag} {name}") for label, name in signatures.SPDX if label in signatures.COMPOSED]
    whole = [Rule(label, GRANT, "spdx", pattern, hides=False) for label, pattern in composed + later]
    return [Rule(label, priority, keyword_of(pattern), pattern) for label, priority, pattern in made] + versions + whole


RULES = _rules()


class Detection(NamedTuple):
    start: int
    end: int
    rule: int


def resolve(found: list[Detection]) -> list[Detection]:
    """Suppress what lies inside a detection that outranks it: by priority, then length, then rule order. One sweep by
    start; the largest end so far is kept for each priority."""
    rank = lambda d: (d.start, -d.end, -RULES[d.rule].priority, d.rule)
    reach: dict[int, int] = {}
    kept = []
    for d in sorted(found, key=rank):
        own = RULES[d.rule].priority
        if own == BASE_PRIORITY or not RULES[d.rule].hides or not any(end >= d.end for priority, end in reach.items() if priority >= own):
            kept.append(d)
        if RULES[d.rule].hides:
            reach[own] = max(reach.get(own, 0), d.end)
    return sorted(kept)


class Scanner:
    def __init__(self):
        import ahocorasick

        self.gates = ahocorasick.Automaton()
        by_gate: dict[str, list[int]] = {}
        for k, rule in enumerate(RULES):
            by_gate.setdefault(f" {rule.keyword}" + ("" if rule.prefix else " "), []).append(k)
        for gate, members in by_gate.items():
            self.gates.add_word(gate, members)
        self.gates.make_automaton()
        self.patterns = [re.compile(rf"(?<= ){r.pattern}(?= )") for r in RULES]

    def scan(self, text: str | None) -> tuple[int, list[Detection], str]:
        """How many words, the resolved detections in word numbers, and the words between blanks."""
        parts = (text or "").encode().translate(WORD_BYTES).split()
        if not parts:
            return 0, [], ""
        words = f" {b' '.join(parts).decode('latin-1')} "  # a character for each byte
        due: set[int] = set()
        for _, members in self.gates.iter(words):
            due.update(members)
        found: list[Detection] = []
        for k in sorted(due):
            counted = upto = 0
            for m in self.patterns[k].finditer(words):
                counted += words.count(" ", upto, m.start())
                upto = m.start()
                found.append(Detection(counted - 1, counted + m[0].count(" "), k))
        return len(parts), resolve(found) if found else [], words


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


DETECTIONS = "n_words long, detections array<struct<start: long, end: long, label: string, priority: int, base: boolean>>"


def with_detections(df: DataFrame, *, text: str = "text") -> DataFrame:
    """Add ``n_words`` and ``detections``: word ranges (end excluded) with label and priority, in order."""
    from pyspark.sql.pandas.functions import PandasUDFType, pandas_udf

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for x in batch:
                n, found, _ = scanner().scan(x if isinstance(x, str) else None)
                rows.append((n, [{"start": d.start, "end": d.end, "label": RULES[d.rule].label, "priority": RULES[d.rule].priority, "base": RULES[d.rule].priority == BASE_PRIORITY} for d in found]))
            yield pd.DataFrame(rows, columns=["n_words", "detections"])

    scan = pandas_udf(run, DETECTIONS, PandasUDFType.SCALAR_ITER)
    return df.select(store.whole_row(df, ("n_words", "detections")).alias("row"), scan(store.column(text)).alias("scan")).select("row.*", "scan.*")


def op4_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = store.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = with_detections(documents).drop("text")
    base = F.expr("filter(detections, d -> d.base)")
    label = lambda rows: F.array_join(F.array_sort(F.array_distinct(F.transform(rows, lambda d: d["label"]))), ",")
    strongest = F.coalesce(F.array_max(F.transform("detections", lambda d: d["priority"])), F.lit(0))
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda d: d["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda d: d["start"])).alias("last_word"),
        label(base).alias("base_labels"),
        label(F.col("detections")).alias("labels"),
        (strongest / F.lit(float(BASE_PRIORITY))).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the query above: the places of the base phrases."""
    return op4_license_rules(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {"op4_license_rules": op4_license_rules, "license_base": license_base}
SQL = {
    "license_base": """
        WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        h AS (
            SELECT doc_id, len(w) AS n_words, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS a,
                list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS b,
                list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS c FROM w
        )
        SELECT doc_id, n_words, len(a) + len(b) + len(c) AS n_base, list_min(list_concat(a, b, c)) AS first_word, list_max(list_concat(a, b, c)) AS last_word,
            concat_ws(',', CASE WHEN len(a) > 0 THEN 'cc-by' END, CASE WHEN len(b) > 0 THEN 'gpl' END, CASE WHEN len(c) > 0 THEN 'reserved' END) AS base_labels
        FROM h
    """,
}
