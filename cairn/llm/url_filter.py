"""URL filters: rules first, and for urls that no rule fits the standing of their host in a link graph.

Trust is a personalised PageRank from hosts with allowed pages along the edges between hosts; distrust is one from hosts
with blocked pages along the reversed edges, since a host that points to bad ones is suspect. Edges: links between hosts
in the pages' html, and the ties between a host and the domain above it. A host is judged by the share of trust in both.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ?, # or end, lower-cased in A-Z; empty without ://."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def first_fitting(rules: Sequence[Rule], host: Column, path: Column, value) -> Column:
    """value(rule) of the longest rule that fits; ties go to the first in code point order."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    return F.coalesce(*(F.when(fits(r, host, path), F.lit(value(r))) for r in ordered), F.lit(None).cast("string"))


def host_edges(pages: DataFrame, html_col: str | None) -> DataFrame:
    """pages(host, [html]) → (src, dst, w): one row for each pair of different hosts, w the number of links, or 1 for a tie."""
    hosts = pages.where("host <> ''").select("host").distinct()
    above = F.expr("substring(host, locate('.', host) + 1)")
    ties = hosts.where("length(host) - length(replace(host, '.', '')) >= 2").select(F.col("host").alias("a"), above.alias("b"))
    edges = ties.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*", F.lit(1).alias("w"))
    if html_col:
        target = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1))
        linked = pages.where(F.col(html_col).contains("//")).select(F.col("host").alias("src"), target.alias("dst")).withColumn("dst", lower_ascii(F.col("dst")))
        edges = edges.union(linked.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").cast("int").alias("w")))
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w"))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int | None = None, damping: float = 0.85, tolerance: float = 1e-4, stride: int = 6) -> DataFrame:
    """edges(kind, src, dst, w), seeds(kind, host, mass) → (kind, host, rank): a personalised PageRank for each kind.

    rank = (1 - damping) * seed share + damping * what comes in; a host passes on its rank in proportion to w. Without
    `rounds` it goes on until the ranks change by at most `tolerance` in a round, both summed and as a part of each host's
    own rank; a host that is reached for the first time changes by all of its rank, so that every host within reach gets
    one. `stride` rounds are one plan, whose result is written and tested. After the first plan ranks are extrapolated once
    to where their last two rounds lead if all that still moves goes back and forth along edges, as within ties: the change
    of two rounds is damping ** 2 of that before. From there the rounds go on, so that they end in the same ranks, only sooner.
    """
    share = stored(seeds.join(seeds.groupBy("kind").agg(F.sum("mass").alias("all")), "kind").select("kind", "host", (F.col("mass") / F.col("all")).alias("seed")))
    out = edges.groupBy("kind", "src").agg(F.sum("w").alias("all"))
    parts = stored(edges.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("w") / F.col("all")).alias("part")))
    fresh = share.select("kind", "host", (F.lit(1 - damping) * F.col("seed")).alias("x"), F.lit(0.0).alias("old"), F.lit(0.0).alias("older"))

    def gathered(rank: DataFrame) -> DataFrame:
        moved = rank.join(parts, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.lit(damping) * F.col("rank") * F.col("part")).alias("x"), F.lit(0.0).alias("old"), F.lit(0.0).alias("older"))
        return moved.unionByName(fresh)

    rank, turn, found = share.select("kind", "host", F.col("seed").alias("rank")), 0, None
    while rounds is None or turn < rounds:
        n = stride if rounds is None else min(stride, rounds - turn)
        older = rank
        for _ in range(n - 1):
            older, rank = rank, gathered(rank).groupBy("kind", "host").agg(F.sum("x").alias("rank"))
        none = F.lit(0.0)
        before = rank.select("kind", "host", none.alias("x"), F.col("rank").alias("old"), none.alias("older")).unionByName(older.select("kind", "host", none.alias("x"), none.alias("old"), F.col("rank").alias("older")))
        done, found = found, stored(gathered(rank).unionByName(before).groupBy("kind", "host").agg(F.sum("x").alias("rank"), F.sum("old").alias("old"), F.sum("older").alias("older")))
        if done is not None:
            dropped(done)
        rank, turn = found.select("kind", "host", "rank"), turn + n
        if rounds is None:
            change = F.abs(F.col("rank") - F.col("old"))
            summed, largest = found.agg(F.sum(change), F.max(F.when(change > 0, change / F.greatest("rank", "old")))).first()
            if (summed or 0.0) <= tolerance and (largest or 0.0) <= tolerance:
                break
            if turn == n and n > 1:
                ahead = F.col("older") + (F.col("rank") - F.col("older")) / (1 - damping**2)
                rank = found.select("kind", "host", F.greatest(ahead, F.lit(0.0)).alias("rank"))
    return rank


def filter_urls(pages: DataFrame, rules: Sequence[Rule] = RULES, least_trust: float = 0.5, rounds: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html") -> DataFrame:
    """One row for each row of pages: page_id, host, path, rule, verdict, trust.

    trust: the host's trust / (trust + distrust), null where neither reaches it. Without a rule, a host whose trust is
    at least `least_trust`, or that neither reaches, is allowed. A null url has an empty host and path, and is allowed. Repeated rows are judged each
    and count as so many pages of their host; an empty table gives no rows.
    """
    host, path = host_of(F.col(url_col).cast("string")), path_of(F.col(url_col).cast("string"))
    cols = [F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path")]
    with_html = pages.select(host.alias("host"), *([F.col(html_col).cast("string").alias("html")] if html_col else []))
    base = pages.select(*cols).select("*", first_fitting(rules, F.col("host"), F.col("path"), lambda r: r.text).alias("rule"), first_fitting(rules, F.col("host"), F.col("path"), lambda r: r.verdict).alias("ruled"))
    edges = stored(host_edges(with_html, "html" if html_col else None))
    both = edges.select(F.lit("allow").alias("kind"), "src", "dst", "w").union(edges.select(F.lit("block"), "dst", "src", "w"))
    seeds = base.where("ruled is not null and host <> ''").groupBy(F.col("ruled").alias("kind"), "host").agg(F.count("*").alias("mass"))
    rank = propagate(both, seeds, rounds)
    trust = rank.groupBy("host").agg((F.sum(F.when(F.col("kind") == "allow", F.col("rank")).otherwise(0.0)) / F.sum("rank")).alias("trust"))
    verdict = F.coalesce("ruled", F.when(F.coalesce("trust", F.lit(1.0)) >= least_trust, "allow").otherwise("block"))
    return base.join(trust, "host", "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), "trust")
