"""URL filter: longest matching rule, else trust and distrust propagated over the host graph.

Trust is a personalised PageRank started from hosts with allowed pages and sent along links;
distrust starts from hosts with blocked pages and is sent against them (who links to a blocked
host is suspect). Host edges are the absolute links of the pages plus, in both directions, the step
between a host and its parent domain.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftgauge.llm.storage import collected, stored
from driftgauge.llm.text import lower_ascii, whole
from driftgauge.session import cut_lineage

# (verdict, host, path)
Rule = tuple[str, str, str]

LINK = r"""(?i)href\s*=\s*["']?(?:https?:)?//([^/"'?#>\s]+)"""
SALTS = 8
# edges up to which the walk takes its steps in one partition
STEP_ROWS = 100_000
RELAXED = 0.7


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)
    return lower_ascii(raw), path


def rule_index(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Position of the longest rule that fits, or null."""
    found = F.lit(None).cast("int")
    for i in sorted(range(len(rules)), key=lambda i: (len(rules[i][1] + rules[i][2]), -i)):
        _, of, start = rules[i]
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(start)
        found = F.when(fits, F.lit(i)).otherwise(found)
    return found


def _picked(index: Column, values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index)


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight) over ``pages(host, targets)``: counted links and parent-domain steps."""
    target = F.explode("targets")
    links = (
        pages.where(F.col("host") != "").select(F.col("host").alias("src"), target.alias("dst"))
        .select("src", lower_ascii(F.col("dst")).alias("dst")).where("src <> dst")
        .groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    )
    known = pages.where(F.col("host") != "").select("host").union(links.select("dst")).distinct()
    # every host with its chain of parent domains: a.b.c.d gives (a.b.c.d, b.c.d), (b.c.d, c.d)
    labels = F.split("host", "[.]")
    steps = F.transform(
        F.when(F.size(labels) > 2, F.sequence(F.lit(1), F.size(labels) - 2)).otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.concat_ws(".", F.slice(labels, i, F.size(labels))).alias("a"),
            F.concat_ws(".", F.slice(labels, i + 1, F.size(labels))).alias("b"),
        ),
    )
    chain = known.select(F.explode(steps).alias("s")).select("s.a", "s.b").distinct()
    both = chain.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("weight")).union(
        chain.select("b", "a", F.lit(1.0))
    )
    return links.union(both).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float = 1e-8, cut_every: int = 4) -> DataFrame:
    """(host, trust, distrust) of the converged walk from ``seeds(host, trust, distrust)``.

    Steps end when the scores of each kind are within ``tolerance`` of the limit, summed over hosts: the summed residual over
    ``1 - damping`` bounds that distance. Each step goes the share ``RELAXED`` of the way, as full steps swing between a host and its parent.

    Sender rows are copied to a few salts, so the messages of a host with very many links are dealt over
    several tasks; sums are combined before the shuffle. Mass that reaches a host without links ends there.
    """
    edges = cut_lineage(edges)
    # a small graph needs no exchange between its steps: all of it lies in one partition
    small = edges.count() <= STEP_ROWS
    together = lambda df: df.coalesce(1) if small else df
    forward = edges.select(F.lit("trust").alias("kind"), F.col("src").alias("sender"), F.col("dst").alias("to"), "weight")
    back = edges.select(F.lit("distrust"), F.col("dst"), F.col("src"), F.col("weight"))
    sent = forward.union(back)
    out = sent.groupBy("kind", "sender").agg(F.sum("weight").alias("total"))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    # what stays with a host is a step to itself, so each step reads the state once
    hosts = edges.select("src").union(edges.select("dst")).union(seeds.select("host")).toDF("sender").distinct()
    own = hosts.select(F.explode(F.array(F.lit("trust"), F.lit("distrust"))).alias("kind"), "sender")
    stays = own.select("kind", "sender", F.pmod(F.xxhash64("sender"), F.lit(SALTS)).cast("int").alias("salt"), F.col("sender").alias("to"), F.lit(1 - RELAXED).alias("share"))
    shares = cut_lineage(together(
        sent.withColumn("salt", F.pmod(F.xxhash64("to"), F.lit(SALTS)).cast("int"))
        .join(out.select("kind", "sender", "total", salt), ["kind", "sender", "salt"])
        .select("kind", "sender", "salt", "to", (F.col("weight") / F.col("total") * damping * RELAXED).alias("share"))
        .union(stays)
    ))
    start = cut_lineage(together(
        seeds.select("host", F.explode(F.create_map(F.lit("trust"), "trust", F.lit("distrust"), "distrust")).alias("kind", "seed"))
        .where("seed > 0")
    ))
    base = start.select("host", "kind", (F.col("seed") * (1 - damping) * RELAXED).alias("score"))
    state = start.withColumnRenamed("seed", "score")
    # the residual shrinks by this factor a step at least
    factor = 1 - RELAXED * (1 - damping)
    bound, step, left = 2 * math.ceil(math.log(tolerance) / math.log(factor)) + cut_every, 0, math.inf
    while left > tolerance:
        if step >= bound:
            raise RuntimeError("the walk has not settled")
        for i in range(cut_every):
            if i == cut_every - 1:
                before = state = cut_lineage(state)
            senders = state.select("kind", F.col("host").alias("sender"), "score", salt)
            arrived = shares.join(senders, ["kind", "sender", "salt"]).select(
                F.col("to").alias("host"), "kind", (F.col("score") * F.col("share")).alias("score")
            )
            state = together(arrived.union(base)).groupBy("host", "kind").agg(F.sum("score").alias("score"))
        step += cut_every
        both = state.select("host", "kind", "score", F.lit(0.0).alias("last")).union(before.select("host", "kind", F.lit(0.0), "score"))
        both = cut_lineage(together(both).groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("last").alias("last")))
        changes = both.groupBy("kind").agg(F.sum(F.abs(F.col("score") - F.col("last"))).alias("change"))
        left = 1 / RELAXED / (1 - damping) * (changes.agg(F.max("change")).first()[0] or 0.0)
        state = both.select("host", "kind", "score")
        if step % (8 * cut_every) == 0:
            collected(edges.sparkSession)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0)).alias(kind)
    return state.groupBy("host").agg(of("trust"), of("distrust"))


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
    damping: float = 0.85,
    tolerance: float = 1e-8,
    floor: float = 0.25,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, trust, distrust.

    A host without a fitting rule is blocked when its distrust exceeds its trust and ``floor`` times the mean
    seed of the blocked hosts, both of the converged walk (up to ``tolerance``). Seeds are the shares of a host's pages that rules allow or block.

    Null urls and urls without ``://`` have empty host and path, no rule, and are allowed; null html has no links.
    Repeated rows stay; an empty table gives no rows. Other columns of ``pages`` are not read, so their names cannot clash.
    """
    host, path = url_parts(F.col(url_column).cast("string"))
    targets = F.regexp_extract_all(whole(F.col(html_column)), F.lit(LINK), F.lit(1)).alias("targets")
    judged = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"), targets)
    # the pages are read once; what follows needs their hosts and links alone
    judged = stored(judged.withColumn("rule_at", rule_index(F.col("host"), F.col("path"), rules)), "judged-pages")
    verdicts, names = [r[0] for r in rules], [r[1] + r[2] for r in rules]
    says = _picked(F.col("rule_at"), verdicts)
    share = lambda v: F.avg(F.when(says == v, 1.0).otherwise(0.0))
    shares = judged.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    seeds = cut_lineage(shares)
    totals = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"), F.sum(F.signum("distrust")).alias("n")).first()
    normal = seeds.select(
        "host",
        (F.col("trust") / F.lit(float(totals["t"] or 1.0))).alias("trust"),
        (F.col("distrust") / F.lit(float(totals["d"] or 1.0))).alias("distrust"),
    )
    scores = propagate(host_edges(judged.select("host", "targets")), normal, damping, tolerance)
    least = floor / max(float(totals["n"] or 1.0), 1.0)
    blocked = F.round(F.col("distrust"), 12) > F.greatest(F.round(F.col("trust"), 12), F.lit(least))
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    by_host = scores.select("host", "trust", "distrust", blocked.alias("blocked"), salt)
    rows = judged.drop("targets").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(SALTS)).cast("int"))
    joined = rows.join(by_host, ["host", "salt"], "left")
    method = F.when(F.coalesce("blocked", F.lit(False)), F.lit("block")).otherwise(F.lit("allow"))
    return joined.select(
        "page_id", "host", "path",
        _picked(F.col("rule_at"), names).alias("rule"),
        F.coalesce(says, method).alias("verdict"),
        F.round(F.coalesce("trust", F.lit(0.0)), 9).alias("trust"),
        F.round(F.coalesce("distrust", F.lit(0.0)), 9).alias("distrust"),
    )
