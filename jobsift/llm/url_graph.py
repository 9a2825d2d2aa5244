"""URL filter: host and path rules, and trust propagated over the link graph.

A rule fits its host and all subdomains if the path begins with the rule's
path; the longest fitting rule decides a page. For pages without a rule the
host decides: trust starts at hosts in the share of their pages that rules
allow, distrust in the share that rules block. Trust follows links (a
personalised PageRank: a host passes DAMPING of its score on, split over its
links by their number), distrust follows them backwards, from blocked hosts to
those that link to them. A host is blocked if its distrust exceeds its trust
by more than THRESHOLD, the score of a host without links half of whose pages
are blocked.

Links are counted for each pair of hosts before anything is joined, so a host
with a third of all pages is one row of the graph for each host it links to.
Each round is one join and one sum; it is written to the shared folder. Rounds
go on until scores have settled, on paths and cycles of any length: a round
adds at most DAMPING times what the one before it added, so ROUNDS are always
enough, and less than SETTLED * DAMPING / (1 - DAMPING) of the sum is missing.

Cases: a null url, or one without ``://``, has empty host and path, fits no
rule, is no part of the graph and is allowed; so is a host no trust or
distrust reaches; a null html has no link; links within a host are not
counted; repeated rows count as often as they stand; an empty table gives an
empty result. Only the named columns are read.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, written

DAMPING = 0.85
#: Scores have settled when a round adds at most this share to their sum.
SETTLED = 1e-6
#: Round n adds at most DAMPING ** n of the seeds' sum, so no graph needs more.
ROUNDS = math.ceil(math.log(SETTLED) / math.log(DAMPING))
THRESHOLD = 0.5 * (1 - DAMPING)
#: An absolute or protocol-relative link and its host.
LINK = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting(host: Column, path: Column, rules: tuple[Rule, ...], of) -> Column:
    """``of(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.lit(of(rule))).otherwise(out)
    return out


def links(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(source, target, n): links between different hosts."""
    target = F.explode(F.regexp_extract_all(F.col(html_col), F.lit(LINK), 1))
    return pages.where("host <> ''").select(F.col("host").alias("source"), target.alias("target")).withColumn(
        "target", F.translate("target", string.ascii_uppercase, string.ascii_lowercase)).where(
        "source <> target").groupBy("source", "target").agg(F.count("*").alias("n"))


def propagate(seeds: DataFrame, edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(kind, host, score) from ``seeds`` (kind, host, seed) over ``edges``
    (kind, start, end, weight), where the weights that leave a start sum to 1."""
    base = written(seeds.select("kind", "host", (F.col("seed") * (1 - DAMPING)).alias("score")), "url-seeds")
    current, total = base, base.agg(F.sum("score")).first()[0] or 0.0
    for _ in range(rounds):
        flow = current.join(edges, (current.kind == edges.kind) & (current.host == edges.start)).select(
            current.kind, F.col("end").alias("host"), (F.col("score") * F.col("weight") * DAMPING).alias("score"))
        following = written(base.unionAll(flow).groupBy("kind", "host").agg(F.sum("score").alias("score")), "url-scores")
        now = following.agg(F.sum("score")).first()[0] or 0.0
        if current is not base:
            discard(current)
        current = following
        if now - total <= SETTLED * max(total, 1e-300):
            break
        total = now
    return current


def judge(pages: DataFrame, rules: tuple[Rule, ...], id_col: str = "page_id", url_col: str = "url",
          html_col: str = "html") -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = host_path(F.col(url_col))
    known = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"), host.alias("host"), path.alias("path"))
    known = known.withColumn("rule", fitting(F.col("host"), F.col("path"), rules, lambda r: r.name)).withColumn(
        "ruled", fitting(F.col("host"), F.col("path"), rules, lambda r: r.verdict))
    share = lambda verdict: F.avg(F.when(F.col("ruled") == verdict, 1.0).otherwise(0.0))
    hosts = known.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = hosts.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias(
        "kind", "seed")).where("seed > 0")
    counted = written(links(known, "html"), "url-links")
    out_of = counted.groupBy("source").agg(F.sum("n").alias("all")).withColumnRenamed("source", "h")
    into = counted.groupBy("target").agg(F.sum("n").alias("all")).withColumnRenamed("target", "h")
    ahead = counted.join(out_of, counted.source == out_of.h).select(
        F.lit("trust").alias("kind"), F.col("source").alias("start"), F.col("target").alias("end"),
        (F.col("n") / F.col("all")).alias("weight"))
    back = counted.join(into, counted.target == into.h).select(
        F.lit("distrust").alias("kind"), F.col("target").alias("start"), F.col("source").alias("end"),
        (F.col("n") / F.col("all")).alias("weight"))
    scores = propagate(seeds, written(ahead.unionAll(back), "url-edges"))
    by_host = scores.groupBy(F.col("host").alias("h")).agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")])
    judged = known.drop("html").join(by_host, known.host == by_host.h, "left").withColumns(
        {k: F.coalesce(k, F.lit(0.0)) for k in ("trust", "distrust")})
    own = F.when(F.col("distrust") - F.col("trust") > THRESHOLD, "block").otherwise("allow")
    return judged.select("id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "trust", "distrust")
