"""URL rules, and trust for what no rule decides, propagated over the graph of links between hosts.

Rules are ``host/path`` prefixes; a rule holds for its host and all subdomains, and the longest one that fits decides.
Hosts most of whose pages the rules allow are trusted seeds, hosts most of whose pages they block are
blocked seeds. Two personalised PageRanks run together over the host edges: trust follows links
from the trusted seeds, distrust follows them backwards from the blocked ones (who links to a bad host is suspect).
A host is blocked when its distrust exceeds both its trust and ``threshold`` times the even share of the
distrust; all others are allowed.

Links are counted per pair of hosts before the first shuffle; every round is one join and one combined sum over host edges, and is
written to the shared folder. A host with a third of all pages or links only means larger counts.

A null url, or one without ``://``, has empty host and path, fits no rule, takes no part in the graph and is allowed. Null
html has no links. Null ids and repeated rows are judged like others. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import drop, store


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"),
)

DAMPING = 0.85
THRESHOLD = 0.5
# Ranks are settled when all that may still move is this share of the least distrust that blocks a host. The bound on rounds is only there
# to end a run that cannot settle: ten times the rounds that a thousand million hosts need.
SETTLED, MOST_ROUNDS = 1e-3, 2000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """From after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_columns(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does."""
    name = verdict = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)) if name is None else name.when(fits, F.lit(rule.name))
        verdict = F.when(fits, F.lit(rule.verdict)) if verdict is None else verdict.when(fits, F.lit(rule.verdict))
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def host_edges(pages: DataFrame) -> DataFrame:
    """``src, dst, n``: links between different hosts; relative links stay on their own host and say nothing."""
    links = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""), F.lit(1))
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(links).alias("link"))
    absolute = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    return found.select("src", host_of(absolute).alias("dst")).where("dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, settled: float = SETTLED * THRESHOLD) -> DataFrame:
    """``host, trust, distrust`` for the hosts of ``seeds(host, trusted, blocked)`` and all hosts reached over ``edges``.

    Each of the two seed sets starts with mass 1, dealt evenly; mass at a host without links in the needed direction ends there. Rounds go on until
    what may still move, over all hosts together, is less than ``settled`` times the even share of the distrust of one host.
    """
    totals = seeds.agg(F.sum("trusted").alias("t"), F.sum("blocked").alias("b")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n))) if n else F.lit(0.0)
    start = store(seeds.select("host", share("trusted", totals.t).alias("t0"), share("blocked", totals.b).alias("b0")), "seeds")
    out_n = edges.groupBy("src").agg(F.sum("n").alias("out_n"))
    in_n = edges.groupBy("dst").agg(F.sum("n").alias("in_n"))
    weighted = edges.join(out_n, "src").join(in_n, "dst")
    forward = weighted.select(F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("n") / F.col("out_n")).alias("tw"), F.lit(0.0).alias("bw"))
    backward = weighted.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("tw"), (F.col("n") / F.col("in_n")).alias("bw"))
    flows = store(forward.unionByName(backward), "flows")
    ranks = start.select("host", F.col("t0").alias("trust"), F.col("b0").alias("distrust"))
    if not flows.limit(1).count():
        return ranks.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))
    old = None
    for _ in range(MOST_ROUNDS):
        moved = flows.join(ranks, F.col("at") == F.col("host")).groupBy("to").agg(
            F.sum(F.col("tw") * F.col("trust")).alias("dt"), F.sum(F.col("bw") * F.col("distrust")).alias("db"))
        own = start.select("host", (F.col("t0") * (1 - damping)).alias("dt"), (F.col("b0") * (1 - damping)).alias("db"))
        both = own.unionByName(moved.select(F.col("to").alias("host"), F.col("dt") * damping, F.col("db") * damping).toDF("host", "dt", "db"))
        fresh = store(both.groupBy("host").agg(F.sum("dt").alias("trust"), F.sum("db").alias("distrust")), "ranks")
        was = ranks.select("host", F.col("trust").alias("t"), F.col("distrust").alias("b"))
        moved_by = lambda new, old: F.sum(F.abs(F.col(new) - F.coalesce(old, F.lit(0.0))))
        seen = fresh.join(was, "host", "left").agg(
            (moved_by("trust", "t") + moved_by("distrust", "b")).alias("change"), (F.sum("distrust") / F.count("*")).alias("even"),
            (F.sum("trust") / F.count("*")).alias("even_trust")).first()
        if old is not None:
            drop(old)
        ranks = old = fresh
        # A change shrinks by the damping each round, so this much is left at most.
        if seen.change * damping / (1 - damping) <= settled * (seen.even or seen.even_trust):
            return ranks
    raise RuntimeError(f"ranks did not settle in {MOST_ROUNDS} rounds")


def judge_urls(pages: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, trust, distrust`` for every row of ``pages(page_id, url, html)``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    parts = pages.select("page_id", F.col("html").cast("string").alias("html"), host_of(url).alias("host"), path_of(url).alias("path"))
    name, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    judged = parts.withColumns({"rule": name, "ruled": verdict})
    is_verdict = lambda v: F.sum(F.when(F.col("ruled") == v, 1).otherwise(0))
    seeds = judged.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), is_verdict("allow").alias("allowed"), is_verdict("block").alias("barred"))
    seeds = seeds.select("host", (2 * F.col("allowed") > F.col("n")).cast("int").alias("trusted"), (2 * F.col("barred") > F.col("n")).cast("int").alias("blocked"))
    edges = store(host_edges(parts), "host-edges")
    ranks = store(propagate(edges, seeds), "host-ranks")
    even = ranks.agg(F.sum("distrust") / F.count("*")).first()[0] or 0.0
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") > threshold * even)
    hosts = ranks.select(F.col("host").alias("known"), "trust", "distrust", F.when(bad, "block").otherwise("allow").alias("method"))
    return judged.select("page_id", "host", "path", "rule", "ruled").join(hosts, F.col("host") == F.col("known"), "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", "method", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))
