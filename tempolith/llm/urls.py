"""URL filter: rules first, then trust and distrust propagated over the graph of hosts.

Links in pages give directed edges between hosts: the targets of ``href`` in tags, of refreshes, and of addresses in
a link's query (redirects). Relative links are resolved against the page's ``base`` or its own address. A host's
links to itself are one edge to itself, along which it keeps a share of its rank. Scripts, styles and comments hold no links, and
``mailto:`` and the like lead to no host. Trust is
personalised PageRank from the hosts that an allow rule names, along links; distrust is the same from hosts that
a block rule names, against the links: who links to a blocked host is suspect. Every named host is one seed of
the same weight, parted between trust and distrust as its pages are between both kinds of rules, so both walks
have one scale and a host's seed doesn't depend on how many pages there are. The walks go on until no new host is reached and ranks
change by less than ``TOLERANCE`` of all seeds. A host is blocked if its distrust exceeds ``RATIO`` times its trust; a
host that neither reaches is allowed. A page's verdict is that of the longest rule that fits its URL, else
that of its host. Rank that reaches a host without links is not passed on.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed. Repeated pages
repeat links, which count once per pair of hosts. Hosts number fewer than pages and stay distributed; the edges of a hub
are dealt into parts of ``HUB`` edges, each with a copy of its rank. Other columns pass through; those with a result's name get
``_input`` after theirs. An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from .digests import LOWER, UPPER


class Rule(NamedTuple):
    verdict: str
    rule: str  # host and path

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


#: The rules of the registered query.
RULES = (Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))
DAMPING, RATIO, TOLERANCE = 0.85, 1.0, 1e-4
#: Rounds between two looks at how ranks change; edges of a hub that stay together.
CUT_EVERY, HUB = 4, 100_000
#: What holds no links, and the base's own address.
UNREAD = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<base\b[^>]*>"
BASE = r"""(?is)<base\b[^>]*?\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
HREF = r"""(?i)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*?\burl\s*=\s*["']?\s*([^"'\s>;]+)"""
REDIRECT = r"""(?i)[?&;][^=&;#]*=(?:https?)?(?::|%3a)?((?:/|%2f){2}[^&;#%/?]+)"""


def after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    rest = F.coalesce(after_scheme(url), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(after_scheme(url), F.lit("")), r"^[^/?#]*([^?#]*)", 1)


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        rule = F.when(fits, F.lit(r.rule)).otherwise(rule)
        verdict = F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def target_host(link: Column, own: Column) -> Column:
    """The host that a link leads to from a page whose relative links stay on ``own``; null if to none."""
    return (
        F.when(link.rlike(r"^(?i)[a-z][a-z0-9+.\-]*://"), host_of(link))
        .when(link.startswith("//"), host_of(F.concat(F.lit("http:"), link)))
        .when(link.rlike(r"^(?i)[a-z][a-z0-9+.\-]*:"), F.lit(None))
        .otherwise(own)
    )


def host_edges(pages: DataFrame, *, url: str = "url", html: str = "html") -> DataFrame:
    """Distinct directed edges (src, dst) between hosts, a host's edge to itself included."""
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    read = pages.select(host_of(store.column(url)).alias("src"), F.coalesce(store.column(html), F.lit("")).alias("html")).where("src <> ''")
    read = read.select("src", F.regexp_extract("html", BASE, 1).alias("base"), F.regexp_replace("html", UNREAD, " ").alias("html"))
    read = read.select("src", target_host(F.col("base"), F.col("src")).alias("own"), F.concat(every(F.col("html"), HREF), every(F.col("html"), REFRESH)).alias("links"))
    direct = F.transform("links", lambda x: target_host(x, F.col("own")))
    onward = F.transform(every(F.array_join(F.filter("links", lambda x: x.contains("?")), " "), REDIRECT), lambda x: host_of(F.concat(F.lit("http:"), F.regexp_replace(x, "(?i)%2f", "/"))))
    found = read.select("src", F.explode(F.array_distinct(F.concat(direct, onward))).alias("dst"))
    return found.where("dst <> ''").distinct()


def propagate(seeds: DataFrame, edges: DataFrame, *, damping: float = DAMPING, tolerance: float = TOLERANCE, hub: int = HUB) -> DataFrame:
    """(host, trust, distrust) where both walks have come to rest. ``seeds`` has host, trust and distrust, on one
    scale; both walks share every join and exchange. What a host keeps along its edge to itself is summed at once."""
    degree = lambda end: edges.groupBy(F.col(end).alias("a")).agg((damping / F.count("*")).alias("w"))
    outs, ins = degree("src"), degree("dst")
    forward = edges.join(outs, edges.src == outs.a).select("a", F.col("dst").alias("b"), F.col("w").alias("wt"), F.lit(0.0).alias("wd"))
    backward = edges.join(ins, edges.dst == ins.a).select("a", F.col("src").alias("b"), F.lit(0.0).alias("wt"), F.col("w").alias("wd"))
    steps = store.materialise(forward.unionByName(backward), "host-steps")
    is_own = F.col("a") == F.col("b")
    of_host = steps.groupBy(F.col("a").alias("host")).agg(
        F.ceil(F.count("*") / hub).cast("int").alias("parts"),
        (1 / (1 - F.sum(F.when(is_own, F.col("wt")).otherwise(0.0)))).alias("kept_t"),
        (1 / (1 - F.sum(F.when(is_own, F.col("wd")).otherwise(0.0)))).alias("kept_d"),
    )
    start = seeds.select("host", ((1 - damping) * F.col("trust")).alias("seed_t"), ((1 - damping) * F.col("distrust")).alias("seed_d"))
    nodes = of_host.join(start, "host", "full").select("host", *[F.coalesce(c, F.lit(v)).alias(c) for c, v in (("parts", 1), ("kept_t", 1.0), ("kept_d", 1.0), ("seed_t", 0.0), ("seed_d", 0.0))])
    fixed = ["parts", "kept_t", "kept_d", "seed_t", "seed_d"]
    rank = store.materialise(nodes.withColumns({"trust": F.col("seed_t") * F.col("kept_t"), "distrust": F.col("seed_d") * F.col("kept_d")}), "host-rank")
    onward = store.materialise(
        steps.where(~is_own).join(rank.select(F.col("host").alias("a"), "parts"), "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b", "wt", "wd"), "host-onward"
    )
    store.discard(steps)
    still = tolerance * (rank.agg(F.sum(F.col("seed_t") + F.col("seed_d"))).first()[0] or 0.0)
    reached = -1
    while True:
        before = rank
        for _ in range(CUT_EVERY):
            sent = rank.where("trust > 0 or distrust > 0").select(F.col("host").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "trust", "distrust")
            moved = sent.join(onward, ["a", "part"]).select(F.col("b").alias("host"), (F.col("trust") * F.col("wt")).alias("in_t"), (F.col("distrust") * F.col("wd")).alias("in_d"))
            here = rank.select("host", F.lit(0.0).alias("in_t"), F.lit(0.0).alias("in_d"), *fixed, F.col("trust").alias("was_t"), F.col("distrust").alias("was_d"))
            summed = here.unionByName(moved, allowMissingColumns=True).groupBy("host").agg(F.sum("in_t").alias("in_t"), F.sum("in_d").alias("in_d"), *[F.max(c).alias(c) for c in (*fixed, "was_t", "was_d")])
            rank = summed.withColumns({"trust": (F.col("seed_t") + F.col("in_t")) * F.col("kept_t"), "distrust": (F.col("seed_d") + F.col("in_d")) * F.col("kept_d")})
            rank = rank.withColumn("change", F.abs(F.col("trust") - F.col("was_t")) + F.abs(F.col("distrust") - F.col("was_d"))).drop("in_t", "in_d", "was_t", "was_d")
        rank = store.materialise(rank, "host-rank")
        store.discard(before)
        change, now = rank.agg(F.coalesce(F.sum("change"), F.lit(0.0)), F.count_if(F.col("trust") > 0) + F.count_if(F.col("distrust") > 0)).first()
        if change <= still and now == reached:
            break
        reached = now
    store.discard(onward)
    return rank.select("host", "trust", "distrust")


RESULTS = ("host", "path", "rule", "verdict", "trust", "distrust")


def judged(pages: DataFrame, *, url: str = "url", html: str = "html", rules=RULES, ratio: float = RATIO) -> DataFrame:
    """``pages`` with host, path, rule, trust, distrust and verdict instead of the page's HTML."""
    rest = pages.drop(html)
    named = rest.select(store.whole_row(rest, RESULTS).alias("row"), host_of(store.column(url)).alias("host"), path_of(store.column(url)).alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "by_rule": verdict})
    count = lambda kind: F.count_if(F.col("by_rule") == kind)
    marks = named.where("host <> '' and by_rule is not null").groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked"))
    marks = store.materialise(marks, "host-marks")
    named_hosts = max(marks.count(), 1)
    share = lambda kind: F.col(kind) / (F.col("allowed") + F.col("blocked")) / named_hosts
    seeds = marks.select("host", share("allowed").alias("trust"), share("blocked").alias("distrust"))
    rank = propagate(seeds, host_edges(pages, url=url, html=html))
    store.discard(marks)
    scored = named.join(rank, "host", "left").withColumns({"trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    by_graph = F.when(F.col("distrust") > ratio * F.col("trust"), "block").otherwise("allow")
    return scored.withColumn("verdict", F.coalesce("by_rule", by_graph)).select("row.*", *RESULTS)


def op9_link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(store.read_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "trust", "distrust")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of op9: host, path, the rule that fits, and the verdict of pages that a rule fits."""
    found = op9_link_graph(spark, sf_dir)
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("by_rule"))


QUERIES = {"op9_link_graph": op9_link_graph, "url_rules": url_rules}
SQL = {
    "url_rules": """
        WITH a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        r(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
        f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS by_rule FROM p JOIN r ON ('.' || host) LIKE '%.' || split_part(rule, '/', 1) AND starts_with(path, substr(rule, strpos(rule, '/'))) GROUP BY page_id)
        SELECT page_id, host, path, rule, by_rule FROM p LEFT JOIN f USING (page_id)
    """,
}
