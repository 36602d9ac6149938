"""Quality rules whose cutoffs are certified on labelled documents.

For every stratum and rule, cutoffs are tried from the most lenient to the strictest. A cutoff is certified
when the labelled good documents it would reject are so few that, by the exact binomial tail, a true
rate of false rejections above ``risk / rules`` is excluded at the level ``alpha / (strata x rules)`` (the risk is split over the rules, Bonferroni
over strata and rules; testing in fixed order needs no correction over cutoffs). Documents and texts count once. The strictest certified cutoff is used; without
one the rule rejects nothing in that stratum. Everything is DataFrame expressions.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from driftgauge.llm.storage import stored
from driftgauge.llm.text import BLANKS, whole, words
from driftgauge.session import measured_broadcast

SYMBOLS = "#*$%&|<>"  # fixed value
METRICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
HELD = "metrics"
# rule -> cutoffs from lenient to strict; a document is rejected when its value is above the cutoff
CUTOFFS = {
    "symbols_per_char": [0.5 * 0.8**i for i in range(24)],
    "duplicate_lines": [0.9 * 0.85**i for i in range(16)],
    "repeated_words": [0.5 * 0.8**i for i in range(16)],
    "chars_per_word": [30.0 * 0.93**i for i in range(20)],
    "words_per_char": [0.6 * 0.93**i for i in range(16)],
}


def with_metrics(documents: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(row, text_hash, metrics): ``row`` has the columns ``keep``, so their names cannot clash. Windows of three words are compared by their 64-bit hash."""
    text = whole(F.col("text"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    df = documents.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), text.alias("text"), words(F.col("text")).alias("w"), lines.alias("l"))
    n = F.size("w")
    at = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    window = lambda i: F.struct(F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("i"))
    df = df.select("row", "text", n.alias("n"), "l", F.sort_array(F.transform(at, window)).alias("s"))
    twin = lambda x, k: x["h"].eqNullSafe(F.get("s", k - 1)["h"]) | x["h"].eqNullSafe(F.get("s", k + 1)["h"])
    hit = F.transform(F.filter("s", twin), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    count = lambda c: c.cast("bigint")
    measures = F.struct(
        count(F.col("n")).alias("n_words"),
        count(F.length(F.translate("text", BLANKS, ""))).alias("word_chars"),
        count(F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        count(F.size("l")).alias("n_lines"),
        count(F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"),
        count(F.size(F.array_distinct(F.flatten(hit)))).alias("n_repeat_words"),
    )
    return df.select("row", F.xxhash64("text").alias("text_hash"), measures.alias(HELD))


def base_failed(of: str = HELD) -> Column:
    n = F.col(f"{of}.n_words")
    return (n < 50) | (100 * F.col(f"{of}.n_repeat_words") > 50 * n)


def rule_values(of: str = HELD) -> dict[str, Column]:
    col = lambda name: F.col(f"{of}.{name}").cast("double")
    ratio = lambda a, b: col(a) / F.greatest(col(b), F.lit(1.0))
    return {
        "symbols_per_char": ratio("n_symbols", "word_chars"),
        "duplicate_lines": ratio("n_dup_lines", "n_lines"),
        "repeated_words": ratio("n_repeat_words", "n_words"),
        "chars_per_word": ratio("word_chars", "n_words"),
        "words_per_char": ratio("n_words", "word_chars"),
    }


def binomial_tail_log(k: Column, n: Column, p: float) -> Column:
    """Natural log of P(Bin(n, p) <= k), by its terms in log space."""
    first = n * F.lit(math.log1p(-p))
    odds = math.log(p) - math.log1p(-p)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + F.lit(odds)
        top = F.greatest(acc["total"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["total"] - top) + F.exp(term - top))).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, start, add)["total"]


def certified_cutoffs(measured: DataFrame, labels: DataFrame, risk: float, alpha: float) -> DataFrame:
    """(stratum, cuts) with a map of cutoffs from ``measured(doc_id, text_hash, stratum, metrics)`` and ``labels(doc_id, good)``.

    Only documents that the fixed base rules let through are counted. Several labels of a document: all must be good. A trial of the binomial is one
    document and one text: a doc_id with several rows counts once, by the text with the smallest hash, and a text that several documents have counts once in a stratum.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.col("good").cast("int")).alias("good")).where("good = 1")
    holdout = measured.where(~base_failed()).join(good.select("doc_id"), "doc_id", "left_semi")
    one = holdout.groupBy("doc_id").agg(F.min(F.struct("text_hash", "stratum", HELD)).alias("d")).select("d.*")
    trials = one.groupBy("stratum", "text_hash").agg(F.min(HELD).alias(HELD))
    cells = F.array(*[
        F.struct(F.lit(name).alias("rule"), F.size(F.filter(F.array(*map(F.lit, CUTOFFS[name])), lambda c: value <= c)).alias("step"))
        for name, value in rule_values().items()
    ])
    counts = trials.select("stratum", F.explode(cells).alias("c")).groupBy("stratum", "c.rule", "c.step").agg(F.count("*").alias("n"))
    ladder = F.explode(F.array(*[
        F.struct(F.lit(name).alias("rule"), F.lit(i).alias("step"), F.lit(c).alias("cutoff")) for name, cuts in CUTOFFS.items() for i, c in enumerate(cuts)
    ])).alias("l")
    strata = counts.groupBy("stratum").agg((F.sum("n") / len(CUTOFFS)).cast("bigint").alias("total"))
    rungs = strata.select("stratum", "total", ladder).select("stratum", "total", "l.*")
    upto = W.Window.partitionBy("stratum", "rule").orderBy("step")
    tested = rungs.join(counts, ["stratum", "rule", "step"], "left").withColumn("k", F.sum(F.coalesce("n", F.lit(0))).over(upto))
    # each rule has its share of the risk; more than the expected number of rejections can never be certified
    share = risk / len(CUTOFFS)
    hopeless = F.col("k") > F.col("total") * share
    tail = F.when(hopeless, F.lit(0.0)).otherwise(binomial_tail_log(F.when(hopeless, F.lit(0)).otherwise(F.col("k")).cast("bigint"), F.col("total"), share))
    level = math.log(alpha / (max(1, strata.count()) * len(CUTOFFS)))
    passed = tested.where(tail <= level)
    strictest = passed.groupBy("stratum", "rule").agg(F.min("cutoff").alias("cutoff"))
    return strictest.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cuts"))


def apply_rules(
    documents: DataFrame, labels: DataFrame, keep: Sequence[str], stratum_column: str = "lang", risk: float = 0.02, alpha: float = 0.05
) -> DataFrame:
    """(row, metrics, base_failed, kept): ``row`` has the columns ``keep`` of ``documents``, ``doc_id`` and the stratum among them.

    With probability ``1 - alpha`` at least, in every stratum at most the share ``risk`` of good documents that pass the base rules is rejected by the rules
    together. ``labels`` has doc_id and a boolean ``good``. A null stratum is a stratum of its own, apart from an empty one; strata without enough labelled
    documents keep what the base rules keep. Null and blank texts have no words and fail the base rules.
    Repeated rows are measured like any other and count once as labelled documents; an empty table gives no rows.
    """
    measured = stored(with_metrics(documents, keep), "quality-metrics")
    # the first character tells null from empty
    stratum = F.coalesce(F.concat(F.lit("="), F.col("row").getField(stratum_column).cast("string")), F.lit("")).alias("stratum")
    cuts = certified_cutoffs(measured.select(F.col("row.doc_id").alias("doc_id"), "text_hash", stratum, HELD), labels, risk, alpha)
    cuts = stored(cuts, "quality-cutoffs")
    joined = measured.withColumn("stratum", stratum).join(measured_broadcast(cuts, 512), "stratum", "left")
    above = F.lit(False)
    for name, value in rule_values().items():
        above = above | F.coalesce(value > F.element_at("cuts", F.lit(name)), F.lit(False))
    failed = base_failed()
    return joined.select("row", F.col(HELD), failed.alias("base_failed"), (~failed & ~above).alias("kept"))
