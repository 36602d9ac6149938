"""Queries of the replicate-summary and ledger family (L)."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import summaries
from driftgauge.operators.ranks import needs_blocks
from driftgauge.operators.replicate_blocks import replicate_errors
from driftgauge.operators.resample import bootstrap, place_units
from driftgauge.plans.bindings import SQL_SCORED, SQL_SUPPLIERS, scored_suppliers, sql_bootstrap
from driftgauge.plans.intake import SQL_LEDGER, ledger_rows
from driftgauge.plans.registry import query
from driftgauge.session import cut_lineage

B = 2000


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


SQL_VALUES = """
joined AS (SELECT s.grp AS cell, b.replicate, b.m, s.q_hat - s.q_true AS e FROM boot b JOIN scored s USING (unit_id)),
wide AS (SELECT cell, replicate, sum(m * abs(e)) / sum(m) AS mae, sum(m * e) / sum(m) AS bias FROM joined WHERE replicate > 0 GROUP BY 1, 2),
vals AS (SELECT cell, replicate, metric, value FROM wide UNPIVOT (value FOR metric IN (mae, bias)))
"""


def replicate_values(spark, sf_dir, seed=2026):
    """``(cell, replicate, metric, value)``: weighted errors of each region in each replicate."""
    units = scored_suppliers(spark, sf_dir).select("domain", "unit_id", F.col("grp").alias("cell"), (F.col("q_hat") - F.col("q_true")).alias("e"))
    if needs_blocks(units, ["domain"]):
        m = F.col("multiplicity")
        copies = bootstrap(units, ["domain"], "unit_id", resamples=B, seed=seed, blocks=True)
        wide = copies.groupBy("cell", "replicate").agg(
            (F.sum(m * F.abs("e")) / F.sum(m)).alias("mae"), (F.sum(m * F.col("e")) / F.sum(m)).alias("bias")
        )
    else:
        # a region lies in one domain, so its errors in a replicate come from one task
        placed = place_units(units, ["domain"], "unit_id", seed, blocks=False)
        wide = replicate_errors(placed, ["domain"], "unit_id", "cell", "e", resamples=B, seed=seed).where("replicate > 0")
    # a row a region and replicate, read twice: for the sizes of its groups and for the summary
    wide = cut_lineage(wide.select("cell", "replicate", "mae", "bias"))
    return wide.select("cell", "replicate", F.explode(F.create_map(F.lit("mae"), F.col("mae"), F.lit("bias"), F.col("bias"))).alias("metric", "value"))


SQL_SUMMARY = """SELECT cell, metric, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS p2_5, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.975) AS p97_5 FROM {v} GROUP BY 1, 2"""


@query("L1_replicate_summary", f"""WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)}, {SQL_VALUES}, s AS ({SQL_SUMMARY.format(v='vals')})
SELECT cell, metric, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(p2_5, 6) AS p2_5, round(p50, 6) AS p50, round(p97_5, 6) AS p97_5 FROM s""")
def replicate_summary(spark, sf_dir):
    out = summaries.replicate_summary(replicate_values(spark, sf_dir), ["cell", "metric"], "value")
    return rounded(out, "mean", "sd", "p2_5", "p50", "p97_5")


def _renamed(sql: str, suffix: str) -> str:
    """The bootstrap CTEs under other names, for a second seed in one statement."""
    for name in ("slot", "hashed", "draws", "boot", "joined", "wide", "vals"):
        for before, after in ((f"{name} AS (", f"{name}{suffix} AS ("), (f"FROM {name}", f"FROM {name}{suffix}"), (f"JOIN {name} ", f"JOIN {name}{suffix} ")):
            sql = sql.replace(before, after)
    return sql


@query("L2_bias_vs_reference", f"""WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)}, {SQL_VALUES}, s AS ({SQL_SUMMARY.format(v='vals')}),
{_renamed(sql_bootstrap('scored', B, 7) + ',' + SQL_VALUES, '_ref')}, r AS ({SQL_SUMMARY.format(v='vals_ref')})
SELECT s.cell, s.metric, s.n, r.n AS n_ref, round(s.mean, 6) AS mean, round(r.mean, 6) AS mean_ref, round(s.mean - r.mean, 6) AS bias, round(sqrt(s.sd * s.sd / s.n + r.sd * r.sd / r.n), 6) AS mcse
FROM s JOIN r ON r.cell = s.cell AND r.metric = s.metric""")
def bias_vs_reference(spark, sf_dir):
    keys = ["cell", "metric"]
    drawn = summaries.replicate_summary(replicate_values(spark, sf_dir), keys, "value")
    reference = summaries.replicate_summary(replicate_values(spark, sf_dir, seed=7), keys, "value")
    return rounded(summaries.bias_vs_reference(drawn, reference, keys), "mean", "mean_ref", "bias", "mcse")


FLAGS = ("below_zero", "above_zero", "covers_reference", "covers_zero")
SQL_RATES = ", ".join(f"round(avg({f}), 6) AS {f}, round(sqrt(avg({f}) * (1 - avg({f})) / count(*)), 6) AS {f}_se" for f in FLAGS)


@query("L3_decision_rates", f"""WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)}, {SQL_VALUES}, iv AS (SELECT cell, value - 0.02::DOUBLE AS lo, value + 0.02::DOUBLE AS hi FROM vals WHERE metric = 'bias'),
f AS (SELECT cell, hi - lo AS w, (hi < 0)::INT AS below_zero, (lo > 0)::INT AS above_zero, (0.05::DOUBLE BETWEEN lo AND hi)::INT AS covers_reference, (0 BETWEEN lo AND hi)::INT AS covers_zero FROM iv)
SELECT cell, count(*) AS n, round(avg(w), 6) AS mean_width, {SQL_RATES} FROM f GROUP BY 1""")
def decision_rates(spark, sf_dir):
    bias = replicate_values(spark, sf_dir).where("metric = 'bias'")
    intervals = bias.withColumns({"lo": F.col("value") - 0.02, "hi": F.col("value") + 0.02})
    out = summaries.decision_rates(intervals, ["cell"], "lo", "hi", F.lit(0.05))
    return rounded(out, "mean_width", *FLAGS, *[f"{f}_se" for f in FLAGS])


SQL_KEYS = "need AS (SELECT r_name || '-' || role || '-mae' AS result_id FROM region, (VALUES ('EVAL'), ('FINAL')) v(role))"


def required_keys(spark, sf_dir):
    regions = spark.read.parquet(f"{sf_dir}/region.parquet")
    roles = F.explode(F.array(F.lit("EVAL"), F.lit("FINAL")))
    return regions.select("r_name", roles.alias("role")).select(F.concat_ws("-", "r_name", "role", F.lit("mae")).alias("result_id"))


@query("L4_ledger_lookup", f"WITH {SQL_SCORED}, {SQL_LEDGER}, {SQL_KEYS} SELECT result_id, full_precision, display, status FROM ledger JOIN need USING (result_id)")
def ledger_lookup(spark, sf_dir):
    found = summaries.ledger_lookup(ledger_rows(spark, sf_dir), required_keys(spark, sf_dir))
    return found.select("result_id", "full_precision", "display", "status")


@query("L4_ledger_violations", f"""WITH {SQL_SCORED}, {SQL_LEDGER}, {SQL_KEYS} SELECT 'missing' AS "check", result_id AS key, 'no row' AS detail FROM need WHERE result_id NOT IN (SELECT result_id FROM ledger)
UNION ALL SELECT 'content', result_id, 'display' FROM ledger WHERE display = '' AND result_id IN (SELECT result_id FROM need)""")
def ledger_violations(spark, sf_dir):
    return summaries.ledger_violations(ledger_rows(spark, sf_dir), required_keys(spark, sf_dir))


@query("L5_integer_total", f"""WITH {SQL_SCORED}, {SQL_LEDGER} SELECT quantity, CASE WHEN count(*) FILTER (full_precision < 0 OR full_precision <> floor(full_precision)) = 0 THEN sum(full_precision)::BIGINT ELSE -1 END AS total,
  count(*) FILTER (full_precision < 0 OR full_precision <> floor(full_precision)) AS n_bad FROM ledger GROUP BY 1""")
def integer_total(spark, sf_dir):
    out = summaries.integer_total(ledger_rows(spark, sf_dir), ["quantity"], "full_precision")
    return out.withColumn("total", F.coalesce("total", F.lit(-1)))


@query("L6_endpoint_table", f"""WITH {SQL_SCORED}, {SQL_LEDGER} SELECT endpoint, dataset, max(display) FILTER (quantity = 'n') AS n, max(display) FILTER (quantity = 'mae') AS mae FROM ledger GROUP BY 1, 2""")
def endpoint_table(spark, sf_dir):
    return summaries.endpoint_table(ledger_rows(spark, sf_dir), ["n", "mae"])
