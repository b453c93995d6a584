"""Term statistics, glossaries and corrections: AGG-06, AGG-07, AGG-26, J-15, J-16, J-17, PRJ-09, PRJ-10, SET-01 to
SET-03, STR-18, STR-27, ORC-34, TOP-09."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import within_one_edit

WORD = r"[A-Za-z][A-Za-z0-9+#.\-]*[A-Za-z0-9+#]|[A-Za-z]"


def term_counts(df: DataFrame, *, key: Sequence[str], text: str, least: int = 2, top: int | None = 40, stop: Sequence[str] = (), pattern: str = WORD) -> DataFrame:
    """Counts of Latin terms per key, case variants summed under the most frequent spelling (ties: the first in
    byte order), the ``top`` most frequent ones."""
    words = df.select(*key, F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).alias("w"))
    spelled = words.groupBy(*key, "w").agg(F.count("*").alias("n"))
    folded = spelled.withColumn("low", F.lower("w")).where(~F.col("low").isin([s.lower() for s in stop]) if stop else F.lit(True))
    summed = folded.groupBy(*key, "low").agg(F.sum("n").alias("count"), F.max("n").alias("_most"), F.min_by("w", F.struct(-F.col("n"), F.col("w"))).alias("term"))
    kept = summed.where(F.col("count") >= least)
    if top is not None:
        w = Window.partitionBy(*key).orderBy(F.desc("count"), "term")
        kept = kept.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= top)
    return kept.select(*key, "term", "count")


def edit_variants(terms: DataFrame, canonical: DataFrame, *, key: Sequence[str] = (), term: str = "term", target: str = "canonical") -> DataFrame:
    """Terms with a canonical term at an edit distance of at most one, ignoring case. Of several the first in
    byte order wins. Terms of two letters match longer ones only, by a deletion.

    Candidates meet on deletion keys: two words within one edit share one of the words that result from
    deleting at most one letter, so no term meets all others.
    """
    def keyed(df: DataFrame, c: str) -> DataFrame:
        low = F.lower(c)
        cuts = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.concat(F.substring(low, F.lit(1), i - 1), F.substring(low, i + 1, F.length(low))))
        return df.where(F.length(c) > 0).withColumn("_cut", F.explode(F.array_distinct(F.concat(F.array(low), cuts))))

    pairs = keyed(terms, term).join(keyed(canonical, target), [*key, "_cut"]).drop("_cut")
    short = F.length(term) <= 2
    fits = within_one_edit(F.col(term), F.col(target)) & (~short | (F.length(target) >= 3) | (F.lower(term) == F.lower(target)))
    return pairs.where(fits & (F.col(term) != F.col(target))).groupBy(*key, term).agg(F.min(target).alias(target))


def usable_pair(wrong: Column, right: Column, function_words: Sequence[str] = ()) -> Column:
    """Whether a correction can be applied by search: two characters at least, not punctuation only, not a
    function word, not onto itself."""
    bare = F.regexp_replace(wrong, r"(?U)[\s\W_]+", "")
    ok = (F.length(bare) > 0) & (F.length(wrong) >= 2) & (wrong != right) & (F.length(F.trim(right)) > 0)
    return F.coalesce(ok & ~wrong.isin(list(function_words)) if function_words else ok, F.lit(False))


def distilled(pairs: DataFrame, *, key: Sequence[str], wrong: str, right: str, short: int = 8, examples: int = 5, order: str) -> DataFrame:
    """Pairs of up to ``short`` characters as counted terms; of longer ones the first ``examples``."""
    counted = pairs.where(F.length(wrong) <= short).groupBy(*key, wrong, right).agg(F.count("*").alias("count")).withColumn("kind", F.lit("term"))
    w = Window.partitionBy(*key).orderBy(order)
    longer = pairs.where(F.length(wrong) > short).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= examples)
    return counted.unionByName(longer.select(*key, wrong, right, F.lit(1).cast("long").alias("count"), F.lit("example").alias("kind")))


def sibling_corrections(corrections: DataFrame, members: DataFrame, *, entity: str, family: str, wrong: str = "wrong", right: str = "right") -> DataFrame:
    """For every entity the corrections of the others of its family, counted. The family's sums minus the
    entity's own, so siblings are not paired with one another."""
    own = corrections.join(members, entity).groupBy(family, entity, wrong, right).agg(F.count("*").alias("own"))
    total = own.groupBy(family, wrong, right).agg(F.sum("own").alias("total"))
    every = members.join(total, family).join(own, [family, entity, wrong, right], "left")
    return every.withColumn("count", F.col("total") - F.coalesce("own", F.lit(0))).where("count > 0").select(entity, wrong, right, "count")


def keyword_leanings(df: DataFrame, keywords: Sequence[tuple[str, str]], *, key: Sequence[str], text: str) -> DataFrame:
    """Hits of (keyword, lean) per lean in a text, ignoring case; a keyword counts once. The list is a parameter
    and evaluated in place."""
    leans = sorted({lean for _, lean in keywords})
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hits = {f"n_{lean}": sum((F.when(low.contains(w.lower()), 1).otherwise(0) for w, x in keywords if x == lean), F.lit(0)) for lean in leans}
    return df.select(*key, *(c.alias(n) for n, c in hits.items()))


def effective_glossary(glossary: DataFrame, profile: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """A confirmed glossary wins, else a proposal, else the profile's terms; ``status`` tells which."""
    both = profile.select(*key, F.col("terms_use").alias("_profile")).join(glossary.select(*key, "confirmed", "terms_use"), list(key), "full")
    status = F.when(F.col("confirmed"), "confirmed").when(F.col("terms_use").isNotNull(), "proposed").otherwise("profile")
    return both.select(*key, F.coalesce("terms_use", "_profile").alias("terms_use"), status.alias("status"))


def reviewed(glossary: DataFrame, *, drop: Sequence[str] = (), add: Sequence[str] = (), avoid: dict[str, str] | None = None, confirm: bool = False) -> DataFrame:
    """(terms - drop) + add in order; the avoid map updated, later entries winning."""
    entries = F.create_map(*[F.lit(x) for kv in (avoid or {}).items() for x in kv]) if avoid else F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old = F.coalesce("terms_avoid", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(entries), k)), entries)
    terms = F.array_union(F.array_except(F.coalesce("terms_use", F.array().cast("array<string>")), F.array(*map(F.lit, drop)).cast("array<string>")), F.array(*map(F.lit, add)).cast("array<string>"))
    return glossary.withColumns({"terms_use": terms, "terms_avoid": merged, "confirmed": F.lit(True) if confirm else F.col("confirmed")})


def proposed(glossary: DataFrame, profile: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """Insert keys that have no glossary yet; for the others refresh the proposal only."""
    fresh = profile.select(*key, F.col("terms_use").alias("_new"))
    both = glossary.join(fresh, list(key), "full")
    return both.select(*key, F.coalesce("confirmed", F.lit(False)).alias("confirmed"), F.coalesce("terms_use", "_new").alias("terms_use"), F.col("_new").alias("proposal"))


def counts_by(df: DataFrame, column: str, *, key: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*key, column).agg(F.count("*").alias("n"))
