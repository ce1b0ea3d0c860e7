"""URL verdicts by rules, and for the rest by trust and distrust carried over host edges.

Everything is DataFrame work: links are taken from the pages with regular expressions, folded to
weighted edges between hosts, and personalised PageRank runs as join-and-sum steps until no host
changes by more than ``TOLERANCE``: trust forward from hosts that rules allow, distrust backwards
from hosts that rules block, both in the same steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackhouse.llm.columns import quoted
from trackhouse.session import durable

DAMPING = 0.85
#: Steps end when no host's value changes by more than this. A change shrinks by ``DAMPING`` a step
#: at least, so about 85 steps always suffice; they also take a value to hosts as many links away.
TOLERANCE = 1e-6
#: A step in this many is written to the checkpoint folder, so plans and lost work stay small; the
#: change is taken over the last of them.
CUT_EVERY = 5
#: Edges of a partition while values spread; a step makes no more partitions than the edges need.
EDGES = 250_000
#: A host is blocked when its distrust exceeds its trust by this factor.
FACTOR = 1.0
#: Parts that the pages of a host are spread over when its values are joined to them.
SALTS = 16
#: Weight of the edges between a host and its parent domain, beside links that count 1 each.
PARENT_WEIGHT = 0.5
#: An absolute or protocol-relative link of a page; the group is its host.
LINK = r"""(?i)(?:href|src)\s*=\s*["']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(lower_ascii(found), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def matching_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and action of the longest rule that fits; of equally long ones a block wins."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.action != "block", r.name))
    name = action = F.lit(None).cast("string")
    for rule in reversed(ordered):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name = F.when(fits, F.lit(rule.name)).otherwise(name)
        action = F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


def host_edges(pages: DataFrame, html: str) -> DataFrame:
    """``(src, dst, weight)`` between different hosts: links of pages, summed before the shuffle, and
    edges both ways between a host and its parent domain (of two labels at least)."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(quoted(html), F.lit(LINK), F.lit(1))).alias("dst"))
    links = links.select("src", lower_ascii(F.col("dst")).alias("dst")).where("src != '' and dst != '' and src != dst")
    links = links.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    hosts = pages.select("host").where("host != ''").unionByName(links.select(F.col("dst").alias("host"))).distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(0), F.size(labels) - 2), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    steps = hosts.where(F.size(labels) >= 3).select(F.posexplode(F.arrays_zip(F.slice(chain, 1, F.size(chain) - 1).alias("a"), F.slice(chain, 2, F.size(chain)).alias("b"))).alias("i", "s"))
    up = steps.select(F.col("s.a").alias("src"), F.col("s.b").alias("dst")).distinct()
    parents = up.unionByName(up.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumn("weight", F.lit(PARENT_WEIGHT))
    return links.unionByName(parents).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(kind, host, value)`` by personalised PageRank for every ``kind`` of ``edges`` (kind, src,
    dst, weight) and ``seeds`` (kind, host, seed), which sum to any total.

    A host's value is shared over its outgoing edges by weight. Values are rounded each step, so
    that the order of sums does not show. Only one number a check reaches the driver.
    """
    few = max(1, math.ceil(edges.count() / EDGES))
    total = edges.groupBy("kind", "src").agg(F.sum("weight").alias("total"))
    shares = durable(edges.join(total, ["kind", "src"]).select("kind", "src", "dst", (F.col("weight") / F.col("total")).alias("share")).coalesce(few))
    base = durable(seeds.groupBy("kind", "host").agg(F.sum("seed").alias("seed")).coalesce(few))
    own = base.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("value"))
    now = base.select("kind", "host", F.col("seed").alias("value"), F.col("seed").alias("change"))
    largest = 1.0
    while largest > TOLERANCE:
        for step in range(CUT_EVERY):
            sent = now.withColumnRenamed("host", "src").join(shares, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("share") * F.col("value") * DAMPING).alias("value")
            )
            parts = sent.unionByName(own).withColumn("before", F.lit(0.0))
            if step == CUT_EVERY - 1:
                parts = parts.unionByName(now.select("kind", "host", F.lit(0.0).alias("value"), F.col("value").alias("before")))
            sums = parts.groupBy("kind", "host").agg(F.round(F.sum("value"), 12).alias("value"), F.sum("before").alias("before"))
            now = sums.select("kind", "host", "value", F.abs(F.col("value") - F.col("before")).alias("change")).coalesce(few)
        now = durable(now)
        largest = now.agg(F.max("change")).first()[0] or 0.0
    return now.select("kind", "host", "value")


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(id_col, host, path, rule, verdict, trust, distrust)`` for every row of ``pages``.

    A rule's action decides where one fits. Otherwise the host does: it is blocked when the
    distrust that reaches it exceeds the trust. Seeds are hosts by the share of their pages that
    rules allow or block. A null url or one without ``://`` has empty host and path, takes part in
    no edge and is allowed, as is a host that nothing reaches, or less than about ``TOLERANCE``.
    Rows are judged one by one, so repeated rows and null ids are kept; of equally long rules a
    block wins. Other columns of ``pages`` are not read, whatever their names; an empty table
    gives an empty result.
    """
    host, path = host_of(quoted(url)), path_of(quoted(url))
    name, action = matching_rule(rules, F.col("host"), F.col("path"))
    located = pages.select(quoted(id_col).alias("id"), host.alias("host"), path.alias("path"), quoted(html).alias("html"))
    ruled = located.withColumn("rule", name).withColumn("action", action)
    edges = durable(host_edges(located, "html"))
    marks = ruled.where("host != ''").groupBy("host").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("action") == "allow", 1)).alias("good"), F.count(F.when(F.col("action") == "block", 1)).alias("bad")
    )
    marks = durable(marks)
    seeds = marks.select("host", F.explode(F.map_from_arrays(
        F.array(F.lit("trust"), F.lit("distrust")), F.array(F.col("good") / F.col("n"), F.col("bad") / F.col("n"))
    )).alias("kind", "seed")).where("seed > 0")
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight", F.lit("distrust").alias("kind"))
    found = propagate(edges.withColumn("kind", F.lit("trust")).unionByName(turned), seeds)
    values = found.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("trust", "distrust")))
    scores = marks.select("host").join(values, "host", "left").na.fill(0.0)
    # One host may hold a third of all pages: its rows are spread, and the few rows of hosts copied.
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    dealt = ruled.drop("html").withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    joined = dealt.join(scores.withColumn("salt", salts), ["host", "salt"], "left").na.fill(0.0, ["trust", "distrust"])
    by_host = F.when(F.col("distrust") > F.col("trust") * FACTOR, "block").otherwise("allow")
    return joined.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("action", by_host).alias("verdict"), "trust", "distrust")
