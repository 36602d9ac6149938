"""Queries of the resampling, metric, recalibration and endpoint families (D to G)."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import endpoints, metrics, recalibrate, resample
from driftgauge.operators.ranks import quantiles
from driftgauge.plans.bindings import (
    IN_DOMAIN, OUT_DOMAIN, SEEDS, SQL_SCORED, SQL_SUPPLIERS, scored, scored_suppliers, sql_bootstrap, sql_fold, sql_folds, sql_uniform, table,
)
from driftgauge.plans.registry import query

# The whole protocol: 10 repeats of 5 folds, 2,000 replicates. SQL can follow it over the suppliers; what needs no replicates runs over the orders.
B = 2000

SQL_MEDIANS = """
medians AS (
  SELECT h.domain, h.repeat, h.heldout AS fold, count(*) AS n_train, median(s.q_true) AS median
  FROM (SELECT DISTINCT domain, repeat, fold AS heldout FROM folds) h
  JOIN folds f ON f.domain = h.domain AND f.repeat = h.repeat AND f.fold <> h.heldout
  JOIN scored s ON s.unit_id = f.unit_id GROUP BY ALL
)
"""


def samples(spark, sf_dir, resamples=0, source=scored):
    units = source(spark, sf_dir).select("domain", "unit_id", "q_true", "q_hat")
    return endpoints.Samples(units, "domain", "unit_id", "q_true", "q_hat", seeds=SEEDS, resamples=resamples)


@query("E5_crossfit_median", f"""WITH {SQL_SCORED}, {sql_folds('scored')}, {SQL_MEDIANS}
SELECT domain, repeat, fold, n_train, round(median, 8) AS median FROM medians""")
def crossfit_median(spark, sf_dir):
    # medians are whole numbers of 1e-8
    return samples(spark, sf_dir).medians().select("domain", "repeat", "fold", "n_train", F.round("median", 8).alias("median"))


SQL_SKILL = f"""
SELECT f.domain, f.repeat, round(avg(abs(s.q_hat - s.q_true)), 6) AS model_mae, round(avg(abs(m.median - s.q_true)), 6) AS comparator_mae,
  round(1 - avg(abs(s.q_hat - s.q_true)) / avg(abs(m.median - s.q_true)), 6) AS skill
FROM folds f JOIN scored s USING (unit_id) JOIN medians m ON m.domain = f.domain AND m.repeat = f.repeat AND m.fold = f.fold
GROUP BY f.domain, f.repeat"""


@query("G1_deployed_skill", f"WITH {SQL_SCORED}, {sql_folds('scored')}, {SQL_MEDIANS} {SQL_SKILL}")
def deployed_skill(spark, sf_dir):
    table = samples(spark, sf_dir).skills(None)
    return table.select("domain", "repeat", *[F.round(c, 6).alias(c) for c in ("model_mae", "comparator_mae", "skill")])


# --- D: splits, folds, resampling, alignment -------------------------------------------

SEED = 2026
SQL_SEGMENTS = """
segments AS (SELECT c_mktsegment AS stratum, c_custkey::VARCHAR AS unit_id FROM customer)
"""


def segments(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return customer.select(F.col("c_mktsegment").alias("stratum"), F.col("c_custkey").cast("string").alias("unit_id"))


@query("D1_repeated_folds", f"WITH {SQL_SCORED}, {sql_folds('scored')} SELECT domain, unit_id, repeat, fold::INT AS fold FROM folds")
def repeated_folds(spark, sf_dir):
    units = scored(spark, sf_dir).select("domain", "unit_id")
    return resample.long_folds(resample.repeated_folds(units, ["domain"], "unit_id", SEEDS), ["domain", "unit_id"])


@query("D2_align_folds", f"""WITH {SQL_SCORED}, {sql_folds('scored')}
SELECT f.unit_id, f.repeat, f.fold::INT AS fold FROM folds f JOIN scored s USING (unit_id) WHERE s.role = 'EVAL'""")
def align_folds(spark, sf_dir):
    units = scored(spark, sf_dir)
    folds = resample.repeated_folds(units.select("domain", "unit_id"), ["domain"], "unit_id", SEEDS)
    aligned, _ = resample.align_folds(folds, units.where("role = 'EVAL'"), "unit_id")
    return resample.long_folds(aligned, ["unit_id"])


STRATUM_SEED, CONSTANT_SEED = "'2026/' || stratum", "'2026'"
ROLE_SHARES = {"SEG_DEV": "n div 2", "QC_TRAIN": "n div 4", "CALIBRATION": "n div 8", "ID_EVAL": "n - n div 2 - n div 4 - n div 8"}
SQL_QUOTA_ROLE = """CASE WHEN pos < n // 2 THEN 'SEG_DEV' WHEN pos < n // 2 + n // 4 THEN 'QC_TRAIN'
  WHEN pos < n // 2 + n // 4 + n // 8 THEN 'CALIBRATION' ELSE 'ID_EVAL' END"""


def segment_quotas(units):
    counts = units.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    entries = [
        F.struct(F.lit(role).alias("role"), F.lit(i).alias("role_order"), F.expr(share).alias("quota"))
        for i, (role, share) in enumerate(ROLE_SHARES.items())
    ]
    return counts.select("stratum", F.explode(F.array(*entries)).alias("e")).select("stratum", "e.*")


def sql_place(seed_text: str) -> str:
    return f"""
placed AS (SELECT stratum, unit_id, row_number() OVER (PARTITION BY stratum ORDER BY md5(concat_ws(':', {seed_text}, unit_id)), unit_id) - 1 AS pos,
  count(*) OVER (PARTITION BY stratum) AS n FROM segments)"""


@query("D3_fixed_quota_split", f"WITH {SQL_SEGMENTS}, {sql_place(STRATUM_SEED)} SELECT stratum, unit_id, {SQL_QUOTA_ROLE} AS role FROM placed")
def fixed_quota_split(spark, sf_dir):
    units = segments(spark, sf_dir)
    split = resample.quota_split(units, "stratum", "unit_id", segment_quotas(units), resample.stratum_seed(SEED, "stratum"))
    return split.select("stratum", "unit_id", "role")


def _sql_apportion() -> str:
    """Role sizes n/2, n/4, n/8, rest over strata by largest remainder, as a chain of CTEs."""
    parts = ["total AS (SELECT count(*) AS n FROM segments)", "left0 AS (SELECT stratum, count(*) AS lft FROM segments GROUP BY 1)"]
    for i, (role, target) in enumerate([("SEG_DEV", "n // 2"), ("QC_TRAIN", "n // 4"), ("CALIBRATION", "n // 8")]):
        parts.append(f"q{i} AS (SELECT l.*, t.{target} AS tgt, (t.{target} * lft)::DOUBLE / (sum(lft) OVER ())::DOUBLE AS q FROM left{i} l, total t)")
        parts.append(f"r{i} AS (SELECT *, row_number() OVER (ORDER BY q - floor(q) DESC, stratum) AS place, tgt - sum(floor(q)) OVER () AS slots FROM q{i})")
        parts.append(
            f"a{i} AS (SELECT * EXCLUDE (tgt, q, place, slots), (floor(q) + CASE WHEN place <= slots THEN 1 ELSE 0 END)::BIGINT AS {role} FROM r{i})"
        )
        parts.append(f"left{i + 1} AS (SELECT * REPLACE (lft - {role} AS lft) FROM a{i})")
    return ", ".join(parts)


@query("D4_apportion", f"""WITH {SQL_SEGMENTS}, {_sql_apportion()}
SELECT stratum, role, quota FROM (SELECT stratum, SEG_DEV, QC_TRAIN, CALIBRATION, lft AS ID_EVAL FROM left3) UNPIVOT (quota FOR role IN (SEG_DEV, QC_TRAIN, CALIBRATION, ID_EVAL))""")
def apportion(spark, sf_dir):
    units = segments(spark, sf_dir)
    counts = units.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    return resample.apportion(counts, "stratum", role_sizes(units.count())).select("stratum", "role", "quota")


def role_sizes(n: int) -> dict[str, int]:
    sizes = {"SEG_DEV": n // 2, "QC_TRAIN": n // 4, "CALIBRATION": n // 8}
    return {**sizes, "ID_EVAL": n - sum(sizes.values())}


@query("D4_proportional_split", f"""WITH {SQL_SEGMENTS}, {sql_place(STRATUM_SEED)}, {_sql_apportion()}
SELECT stratum, unit_id, CASE WHEN pos < SEG_DEV THEN 'SEG_DEV' WHEN pos < SEG_DEV + QC_TRAIN THEN 'QC_TRAIN'
  WHEN pos < SEG_DEV + QC_TRAIN + CALIBRATION THEN 'CALIBRATION' ELSE 'ID_EVAL' END AS role FROM placed JOIN left3 USING (stratum)""")
def proportional_split(spark, sf_dir):
    units = segments(spark, sf_dir)
    return resample.proportional_split(units, "stratum", "unit_id", role_sizes(units.count()), SEED).select("stratum", "unit_id", "role")


@query("D5_stratified_folds", f"WITH {SQL_SEGMENTS}, {sql_place(STRATUM_SEED)} SELECT stratum, unit_id, {sql_fold('pos', 'n', 5)}::INT AS fold FROM placed")
def stratified_folds(spark, sf_dir):
    return resample.stratified_folds(segments(spark, sf_dir), "stratum", "unit_id", 5, SEED).select("stratum", "unit_id", "fold")


@query("D6_group_permutation_split", f"WITH {SQL_SEGMENTS}, {sql_place(CONSTANT_SEED)} SELECT stratum, unit_id, {SQL_QUOTA_ROLE} AS role FROM placed")
def group_permutation_split(spark, sf_dir):
    units = segments(spark, sf_dir)
    return resample.quota_split(units, "stratum", "unit_id", segment_quotas(units), SEED).select("stratum", "unit_id", "role")


def replicates(spark, sf_dir, resamples=B, **kwargs):
    units = scored_suppliers(spark, sf_dir).select("domain", "unit_id")
    return resample.bootstrap(units, ["domain"], "unit_id", resamples=resamples, seed=SEED, **kwargs)


@query("D7_unit_bootstrap", f"WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)} SELECT domain, replicate::INT AS replicate, unit_id, m AS multiplicity FROM boot WHERE replicate > 0")
def unit_bootstrap(spark, sf_dir):
    return replicates(spark, sf_dir)


def _sql_poisson(u: str) -> str:
    weight, total, out = 0.36787944117144233, 0.0, "CASE"
    for count in range(18):
        total += weight
        weight /= count + 1
        out += f" WHEN {u} < {total!r}::DOUBLE THEN {count}"
    return out + " ELSE 18 END"


@query("D7_poisson_bootstrap", f"""WITH {SQL_SUPPLIERS}, drawn AS (
  SELECT domain, replicate::INT AS replicate, unit_id, {_sql_poisson(sql_uniform("concat_ws(':', '2026', domain, replicate::VARCHAR, unit_id)"))} AS multiplicity
  FROM scored, (SELECT unnest(range(1, {B + 1})) AS replicate)) SELECT * REPLACE (multiplicity::BIGINT AS multiplicity) FROM drawn WHERE multiplicity > 0""")
def poisson_bootstrap(spark, sf_dir):
    return replicates(spark, sf_dir, mode="poisson")


@query("D8_two_population_bootstrap", f"""WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)}
SELECT domain, replicate::INT AS replicate, sum(m)::BIGINT AS n_drawn, count(*) AS n_units, max(m)::BIGINT AS max_copies FROM boot WHERE replicate > 0 GROUP BY 1, 2""")
def two_population_bootstrap(spark, sf_dir):
    return replicates(spark, sf_dir).groupBy("domain", "replicate").agg(
        F.sum("multiplicity").alias("n_drawn"), F.count(F.lit(1)).alias("n_units"), F.max("multiplicity").alias("max_copies")
    )


@query("D9_inherited_folds", f"""WITH {SQL_SUPPLIERS}, {sql_folds('scored')}, {sql_bootstrap('scored', B)}
SELECT b.domain, b.replicate::INT AS replicate, f.repeat, f.fold::INT AS fold, sum(b.m)::BIGINT AS n FROM boot b JOIN folds f ON f.domain = b.domain AND f.unit_id = b.unit_id
WHERE b.replicate > 0 GROUP BY ALL""")
def inherited_folds(spark, sf_dir):
    units = scored_suppliers(spark, sf_dir).select("domain", "unit_id")
    folds = resample.repeated_folds(units, ["domain"], "unit_id", SEEDS)
    copies = resample.inherit_folds(replicates(spark, sf_dir), folds, ["domain", "unit_id"])
    long = resample.long_folds(copies, ["domain", "replicate", "multiplicity"])
    return long.groupBy("domain", "replicate", "repeat", "fold").agg(F.sum("multiplicity").alias("n"))


@query("D10_inheritance_violations", """SELECT l_suppkey AS replicate, l_partkey AS parent, min(l_linenumber % 2)::INT AS lo, max(l_linenumber % 2)::INT AS hi
FROM lineitem GROUP BY ALL HAVING min(l_linenumber % 2) <> max(l_linenumber % 2)""")
def inheritance_violations(spark, sf_dir):
    copies = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("replicate"), F.col("l_partkey").alias("parent"), (F.col("l_linenumber") % 2).alias("fold")
    )
    return resample.inheritance_violations(copies, ["replicate", "parent"])


@query("D11_copy_ordinals", "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS ordinal FROM events")
def copy_ordinals(spark, sf_dir):
    return resample.copy_ordinals(table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", "event_id")


@query("D11_expand_copies", f"""WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)}
SELECT domain, replicate::INT AS replicate, unit_id, m AS multiplicity, unnest(range(m)) AS ordinal FROM boot WHERE replicate > 0""")
def expand_copies(spark, sf_dir):
    return resample.expand_copies(replicates(spark, sf_dir))


SQL_VECTORS = """
truth AS (SELECT o_orderkey::VARCHAR AS unit_id, o_totalprice AS value FROM orders WHERE o_orderstatus <> 'P'),
guess AS (SELECT l_orderkey::VARCHAR AS unit_id, sum(l_extendedprice) AS value FROM lineitem GROUP BY 1)
"""


def vectors(spark, sf_dir):
    truth = table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").cast("string").alias("unit_id"), F.col("o_totalprice").alias("value")
    )
    guess = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("unit_id")).agg(
        F.sum("l_extendedprice").alias("value")
    )
    return {"truth": truth, "guess": guess}


@query("D12_align_vectors", f"WITH {SQL_VECTORS} SELECT unit_id, round(t.value, 6) AS truth, round(g.value, 6) AS guess FROM truth t JOIN guess g USING (unit_id)")
def align_vectors(spark, sf_dir):
    wide, _ = resample.align_vectors(vectors(spark, sf_dir), "unit_id")
    return wide.select("unit_id", F.round("truth", 6).alias("truth"), F.round("guess", 6).alias("guess"))


@query("D12_align_violations", f"""WITH {SQL_VECTORS} SELECT 'align:guess' AS "check", unit_id AS key, 'missing' AS detail FROM truth WHERE unit_id NOT IN (SELECT unit_id FROM guess)
UNION ALL SELECT 'align:guess', unit_id, 'unexpected' FROM guess WHERE unit_id NOT IN (SELECT unit_id FROM truth)""")
def align_violations(spark, sf_dir):
    return resample.align_vectors(vectors(spark, sf_dir), "unit_id")[1]


@query("D13_percentile_interval", f"WITH {SQL_SCORED} SELECT grp, round(quantile_cont(q_true, 0.025), 6) AS ci_low, round(quantile_cont(q_true, 0.975), 6) AS ci_high FROM scored GROUP BY grp")
def percentile_interval(spark, sf_dir):
    return rounded(resample.percentile_interval(scored(spark, sf_dir), ["grp"], "q_true"), "ci_low", "ci_high")


# --- E: metrics ---------------------------------------------------------------------------

def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("E1_regression_metrics", f"""WITH {SQL_SCORED} SELECT domain, role, count(*) AS n, round(avg(abs(q_hat - q_true)), 6) AS mae,
round(sqrt(avg((q_hat - q_true) * (q_hat - q_true))), 6) AS rmse FROM scored GROUP BY 1, 2""")
def regression_metrics(spark, sf_dir):
    return rounded(metrics.regression_metrics(scored(spark, sf_dir), ["domain", "role"], "q_true", "q_hat"), "mae", "rmse")


SQL_CORR = """
WITH {scored}, wide AS (SELECT grp, role, q_true, CASE WHEN role = 'CALIBRATION' THEN 0.5::DOUBLE ELSE q_hat END AS p FROM scored){extra}
"""


def partly_constant(spark, sf_dir):
    p = F.when(F.col("role") == "CALIBRATION", F.lit(0.5)).otherwise(F.col("q_hat"))
    return scored(spark, sf_dir).select("grp", "role", "q_true", p.alias("p"))


@query("E2_pearson", SQL_CORR.format(scored=SQL_SCORED, extra="") + """
SELECT grp, role, count(*) AS n, CASE WHEN min(p) < max(p) THEN round(corr(p, q_true), 6) END AS value, min(p) < max(p) AS defined,
  CASE WHEN min(p) = max(p) THEN 'constant_prediction' END AS reason FROM wide GROUP BY 1, 2""")
def pearson(spark, sf_dir):
    return rounded(metrics.pearson(partly_constant(spark, sf_dir), ["grp", "role"], "q_true", "p"), "value")


@query("E3_spearman", SQL_CORR.format(scored=SQL_SCORED, extra=""", ranked AS (
  SELECT grp, role, p, rank() OVER (PARTITION BY grp, role ORDER BY p) + (count(*) OVER (PARTITION BY grp, role, p) - 1) / 2.0::DOUBLE AS rp,
    rank() OVER (PARTITION BY grp, role ORDER BY q_true) + (count(*) OVER (PARTITION BY grp, role, q_true) - 1) / 2.0::DOUBLE AS rt FROM wide)""") + """
SELECT grp, role, count(*) AS n, CASE WHEN min(p) < max(p) THEN round(corr(rp, rt), 6) END AS value, min(p) < max(p) AS defined,
  CASE WHEN min(p) = max(p) THEN 'constant_prediction' END AS reason FROM ranked GROUP BY 1, 2""")
def spearman(spark, sf_dir):
    return rounded(metrics.spearman(partly_constant(spark, sf_dir), ["grp", "role"], "q_true", "p"), "value")


SQL_COPIES = "copies AS (SELECT domain, replicate, unit_id, unnest(range(m)) AS ordinal FROM boot)"


@query("E4_competence", f"""WITH {SQL_SUPPLIERS}, {sql_bootstrap('scored', B)}, {SQL_COPIES}, v AS (SELECT c.domain, c.replicate, s.q_hat, s.q_true FROM copies c JOIN scored s USING (unit_id)),
ranked AS (SELECT domain, replicate,
    rank() OVER (PARTITION BY domain, replicate ORDER BY q_hat) + (count(*) OVER (PARTITION BY domain, replicate, q_hat) - 1) / 2.0::DOUBLE AS rp,
    rank() OVER (PARTITION BY domain, replicate ORDER BY q_true) + (count(*) OVER (PARTITION BY domain, replicate, q_true) - 1) / 2.0::DOUBLE AS rt FROM v),
rho AS (SELECT domain, replicate, count(*) AS n, corr(rp, rt) AS rho FROM ranked GROUP BY ALL)
SELECT domain, max(n) AS n, round(max(rho) FILTER (replicate = 0), 6) AS rho, round(quantile_cont(rho, 0.025) FILTER (replicate > 0), 6) AS ci_low,
  round(quantile_cont(rho, 0.975) FILTER (replicate > 0), 6) AS ci_high, count(*) FILTER (rho IS NULL) AS n_undefined,
  CASE WHEN quantile_cont(rho, 0.025) FILTER (replicate > 0) > 0 THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS verdict FROM rho GROUP BY domain""")
def competence(spark, sf_dir):
    out = metrics.competence(scored_suppliers(spark, sf_dir), ["domain"], "unit_id", "q_true", "q_hat", resamples=B, seed=SEED)
    return rounded(out, "rho", "ci_low", "ci_high")


@query("E6_relative_skill", f"""WITH {SQL_SCORED} SELECT grp, CASE WHEN avg(abs(0.5 - q_true)) > 0 THEN round(1 - avg(abs(q_hat - q_true)) / avg(abs(0.5 - q_true)), 6) END AS skill
FROM scored GROUP BY grp""")
def relative_skill(spark, sf_dir):
    maes = scored(spark, sf_dir).groupBy("grp").agg(
        F.avg(F.abs(F.col("q_hat") - F.col("q_true"))).alias("model"), F.avg(F.abs(F.lit(0.5) - F.col("q_true"))).alias("comparator")
    )
    return maes.select("grp", F.round(metrics.skill(F.col("model"), F.col("comparator")), 6).alias("skill"))


@query("E7_absolute_errors", f"""WITH {SQL_SCORED} SELECT unit_id, role, round(abs(q_hat - q_true), 6) AS q_hat_abs_error, round(abs(0.5 - q_true), 8) AS q_mean_abs_error FROM scored""")
def absolute_errors(spark, sf_dir):
    units = scored(spark, sf_dir).withColumn("q_mean", F.lit(0.5))
    out = metrics.absolute_errors(units, "q_true", ["q_hat", "q_mean"]).orderBy("role", "unit_id")
    # q_true is a whole number of 2e-8, so eight digits are exact and six would round at ties.
    return out.select("unit_id", "role", F.round("q_hat_abs_error", 6).alias("q_hat_abs_error"), F.round("q_mean_abs_error", 8).alias("q_mean_abs_error"))


@query("E8_risk_coverage", f"""WITH {SQL_SCORED}, run AS (SELECT domain, abs(q_hat - q_true) AS risk,
  avg(abs(q_hat - q_true)) OVER (PARTITION BY domain ORDER BY q_hat, unit_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM scored)
SELECT domain, round(avg(r), 6) AS aurc, round(avg(r) - avg(risk), 6) AS excess_aurc FROM run GROUP BY domain""")
def risk_coverage(spark, sf_dir):
    units = scored(spark, sf_dir).withColumn("risk", F.abs(F.col("q_hat") - F.col("q_true")))
    return rounded(metrics.risk_coverage(units, ["domain"], "risk", "q_hat", "unit_id"), "aurc", "excess_aurc")


@query("E9_interval_score", f"""WITH {SQL_SCORED}, i AS (SELECT domain, q_true AS y, q_hat - 0.2::DOUBLE AS lo, q_hat + 0.2::DOUBLE AS hi FROM scored)
SELECT domain, round(avg((hi - lo) + 20.0 * (greatest(lo - y, 0) + greatest(y - hi, 0))), 6) AS interval_score, round(avg((y BETWEEN lo AND hi)::INT), 6) AS coverage,
  round(avg(hi - lo), 6) AS mean_width FROM i GROUP BY domain""")
def interval_score(spark, sf_dir):
    units = scored(spark, sf_dir).withColumns({"lo": F.col("q_hat") - 0.2, "hi": F.col("q_hat") + 0.2})
    return rounded(metrics.interval_score(units, ["domain"], "q_true", "lo", "hi", 0.1), "interval_score", "coverage", "mean_width")


@query("E10_balanced_domain_mean", f"""WITH {SQL_SCORED}, g AS (SELECT domain, grp, avg(q_true) AS m FROM scored GROUP BY 1, 2)
SELECT domain, count(*) AS n_groups, round(avg(m), 6) AS balanced_mean FROM g GROUP BY domain""")
def balanced_domain_mean(spark, sf_dir):
    return rounded(metrics.balanced_domain_mean(scored(spark, sf_dir), "domain", "grp", "q_true"), "balanced_mean")


# --- F: cross-fitted recalibration -----------------------------------------------------------

SQL_OLS = """
ols AS (
  SELECT h.domain, h.repeat, h.heldout AS fold, count(*) AS n_train, regr_intercept(s.q_true, s.q_hat) AS intercept, regr_slope(s.q_true, s.q_hat) AS slope
  FROM (SELECT DISTINCT domain, repeat, fold AS heldout FROM folds) h
  JOIN folds f ON f.domain = h.domain AND f.repeat = h.repeat AND f.fold <> h.heldout
  JOIN scored s ON s.unit_id = f.unit_id GROUP BY ALL
)
"""


@query("F1_affine_ols", f"""WITH {SQL_SCORED}, {sql_folds('scored')}, {SQL_OLS}
SELECT domain, repeat, fold::INT AS fold, n_train, round(intercept, 6) AS intercept, round(slope, 6) AS slope FROM ols""")
def affine_ols(spark, sf_dir):
    return rounded(samples(spark, sf_dir).coefficients("affine_OLS").drop("replicate"), "intercept", "slope")


def sql_lad(rows: str, keys: tuple[str, ...], start: str) -> str:
    """CTE ``lad``: 80 reweighted least-squares steps over ``rows(keys, x, y, m)`` from the coefficients in ``start``."""
    head = ", ".join(f"r.{c}" for c in keys)
    match = " AND ".join(f"r.{c} = c.{c}" for c in keys)
    w = "m / greatest(abs(y - c.a - c.b * x), 1e-9::DOUBLE)"
    e = "(y - c.a - c.b * x)"
    return f"""
lad AS (
  SELECT {", ".join(keys)}, 0 AS step, a, b, 0.5::DOUBLE AS mid FROM {start}
  UNION ALL
  SELECT {", ".join(keys)}, step + 1, a + sr / sw - slope * (mid + sx / sw), b + slope, mid + sx / sw
  FROM (SELECT *, (sxr - sx * sr / sw) / (sxx - sx * sx / sw) AS slope FROM (
    SELECT {head}, c.step, c.a, c.b, c.mid, sum({w}) AS sw, sum({w} * (x - c.mid)) AS sx, sum({w} * {e}) AS sr, sum({w} * (x - c.mid) * (x - c.mid)) AS sxx, sum({w} * (x - c.mid) * {e}) AS sxr
    FROM {rows} r JOIN lad c ON {match} WHERE c.step < 80 GROUP BY ALL))
)
"""


SQL_L1 = f"""WITH RECURSIVE {SQL_SCORED}, {sql_folds('scored')}, {SQL_OLS},
train AS (SELECT h.domain, h.repeat, h.heldout AS fold, s.q_hat AS x, s.q_true AS y, 1 AS m FROM (SELECT DISTINCT domain, repeat, fold AS heldout FROM folds) h
  JOIN folds f ON f.domain = h.domain AND f.repeat = h.repeat AND f.fold <> h.heldout JOIN scored s ON s.unit_id = f.unit_id),
start AS (SELECT domain, repeat, fold, intercept AS a, slope AS b FROM ols), {sql_lad('train', ('domain', 'repeat', 'fold'), 'start')}
SELECT t.domain, t.repeat, t.fold::INT AS fold, count(*) AS n_train, round(any_value(a), 2) AS intercept, round(any_value(b), 2) AS slope, round(avg(abs(y - a - b * x)), 6) AS mean_abs_error
FROM train t JOIN lad l ON l.domain = t.domain AND l.repeat = t.repeat AND l.fold = t.fold WHERE step = 80 GROUP BY ALL"""


@query("F2_affine_l1", SQL_L1)
def affine_l1(spark, sf_dir):
    """The objective to six digits; the line itself to two.

    Residuals near zero have weights up to 1e9, so rounding moves the later digits of
    the line while the objective stays put.
    """
    prepared = samples(spark, sf_dir)
    fits = recalibrate.training_objectives(prepared.copies, prepared.keys, "q_hat", "q_true", prepared.coefficients("affine_L1"))
    return fits.select(
        "domain", "repeat", "fold", "n_train", F.round("intercept", 2).alias("intercept"), F.round("slope", 2).alias("slope"),
        F.round("mean_abs_error", 6).alias("mean_abs_error"),
    )


def sql_isotonic(rows: str, keys: tuple[str, ...]) -> str:
    """CTEs ``pav`` and ``levels(keys, x0, x1, level)``: pooled blocks over ``rows(keys, x, y, m)``.

    Each step pools every run of neighbouring blocks that violate the order; fits without violations are left as they are.
    """
    head = ", ".join(keys)
    return f"""
pav AS (
  SELECT {head}, row_number() OVER (PARTITION BY {head} ORDER BY x) AS b, x AS x0, x AS x1, w, t, 0 AS step
  FROM (SELECT {head}, x, sum(m)::DOUBLE AS w, sum(m * y) AS t FROM {rows} GROUP BY ALL)
  UNION ALL
  SELECT {head}, grp AS b, min(x0), max(x1), sum(w), sum(t), step + 1 FROM (
    SELECT *, sum(1 - hit) OVER (PARTITION BY {head} ORDER BY b) AS grp, max(hit) OVER (PARTITION BY {head}) AS open FROM (
      SELECT *, coalesce((t / w <= lag(t / w) OVER (PARTITION BY {head} ORDER BY b))::INT, 0) AS hit FROM pav))
  WHERE open = 1 GROUP BY {head}, grp, step
),
levels AS (SELECT {head}, x0, x1, t / w AS level FROM pav QUALIFY step = max(step) OVER (PARTITION BY {head}))
"""


def sql_interpolated(asks: str, keys: tuple[str, ...], columns: str) -> str:
    """Rows of ``asks(keys, x, columns)`` with the isotonic ``prediction``."""
    match = lambda of: " AND ".join(f"a.{c} = {of}.{c}" for c in keys)
    return f"""SELECT {", ".join(f"a.{c}" for c in keys)}, {columns},
    CASE WHEN p.level IS NULL THEN n.level WHEN a.x <= p.x1 OR n.level IS NULL THEN p.level ELSE p.level + (a.x - p.x1) / (n.x0 - p.x1) * (n.level - p.level) END AS prediction
  FROM {asks} a ASOF LEFT JOIN levels p ON {match("p")} AND a.x >= p.x0 ASOF LEFT JOIN levels n ON {match("n")} AND a.x < n.x0"""


FIT = ("domain", "repeat", "fold")
SQL_TRAIN = """
train AS (SELECT h.domain, h.repeat, h.heldout AS fold, s.q_hat AS x, s.q_true AS y, 1 AS m FROM (SELECT DISTINCT domain, repeat, fold AS heldout FROM folds) h
  JOIN folds f ON f.domain = h.domain AND f.repeat = h.repeat AND f.fold <> h.heldout JOIN scored s ON s.unit_id = f.unit_id),
asks AS (SELECT f.domain, f.repeat, f.fold, f.unit_id, s.q_hat AS x, s.q_true AS y FROM folds f JOIN scored s USING (unit_id))
"""
# levels are means of values on a grid of 2e-8, which would often tie when rounded
OFF_GRID = 1.234567e-7


@query("F3_isotonic", f"""WITH RECURSIVE {SQL_SCORED}, {sql_folds('scored')}, {SQL_TRAIN}, {sql_isotonic('train', FIT)},
fitted AS ({sql_interpolated('asks', FIT, 'a.unit_id')})
SELECT domain, unit_id, repeat, fold::INT AS fold, round(prediction + {OFF_GRID}, 6) AS prediction FROM fitted""")
def isotonic(spark, sf_dir):
    out = samples(spark, sf_dir).predictions("isotonic").drop("replicate")
    return out.withColumn("prediction", F.round(F.col("prediction") + OFF_GRID, 6))


@query("F4_crossfit_predictions", f"""WITH {SQL_SCORED}, {sql_folds('scored')}, {SQL_OLS}
SELECT f.domain, f.unit_id, f.repeat, f.fold::INT AS fold, round(o.intercept + o.slope * s.q_hat, 6) AS prediction
FROM folds f JOIN scored s USING (unit_id) JOIN ols o ON o.domain = f.domain AND o.repeat = f.repeat AND o.fold = f.fold""")
def crossfit_predictions(spark, sf_dir):
    return rounded(samples(spark, sf_dir).predictions("affine_OLS").drop("replicate"), "prediction")


# --- G: shift endpoints ------------------------------------------------------------------------

# copies that are in several folds of a repeat, or in none of 0..4
SQL_MISPLACED = """
misplaced AS (SELECT coalesce(sum(n), 0)::BIGINT AS n_misplaced FROM (
  SELECT domain, replicate, repeat, unit_id, any_value(m) AS n FROM (SELECT b.domain, b.replicate, f.repeat, b.unit_id, b.m, f.fold FROM boot b JOIN folds f USING (unit_id))
  GROUP BY domain, replicate, repeat, unit_id HAVING count(*) > 1 OR min(fold) < 0 OR max(fold) > 4))
"""
SQL_DELTAS = """
deltas AS (
  SELECT replicate, avg(skill) FILTER (domain = 'ID') AS s_id, avg(skill) FILTER (domain = 'OOD') AS s_ood,
    avg(skill) FILTER (domain = 'OOD') - avg(skill) FILTER (domain = 'ID') AS delta, count(*) FILTER (skill IS NULL) AS n_undefined FROM skills GROUP BY 1
)
"""
SQL_BOOT_SKILL = f"""
WITH {SQL_SUPPLIERS}, {sql_folds('scored')}, {sql_bootstrap('scored', B)}, {SQL_COPIES}, {SQL_MISPLACED},
v AS (SELECT c.domain, c.replicate, f.repeat, f.fold, s.q_hat, s.q_true FROM copies c JOIN scored s USING (unit_id) JOIN folds f USING (unit_id)),
fits AS (
  SELECT h.domain, h.replicate, h.repeat, h.heldout AS fold, median(v.q_true) AS median,
    CASE WHEN count(*) < 2 THEN NULL WHEN min(v.q_hat) = max(v.q_hat) THEN avg(v.q_true) / (1 + min(v.q_hat) ** 2) ELSE regr_intercept(v.q_true, v.q_hat) END AS intercept,
    CASE WHEN count(*) < 2 THEN NULL WHEN min(v.q_hat) = max(v.q_hat) THEN avg(v.q_true) * min(v.q_hat) / (1 + min(v.q_hat) ** 2) ELSE regr_slope(v.q_true, v.q_hat) END AS slope
  FROM (SELECT DISTINCT domain, replicate, repeat, fold AS heldout FROM v) h
  JOIN v ON v.domain = h.domain AND v.replicate = h.replicate AND v.repeat = h.repeat AND v.fold <> h.heldout GROUP BY ALL
),
maes AS (
  SELECT v.domain, v.replicate, v.repeat, avg(abs({{model}} - q_true)) AS model_mae, avg(abs(median - q_true)) AS comparator_mae, count(*) FILTER (median IS NULL OR {{model}} IS NULL) = 0 AS complete
  FROM v LEFT JOIN fits f ON f.domain = v.domain AND f.replicate = v.replicate AND f.repeat = v.repeat AND f.fold = v.fold GROUP BY v.domain, v.replicate, v.repeat
),
skills AS (
  SELECT domain, replicate, repeat, CASE WHEN complete THEN model_mae END AS model_mae, CASE WHEN complete THEN comparator_mae END AS comparator_mae,
    CASE WHEN complete AND comparator_mae > 0 THEN 1 - model_mae / comparator_mae END AS skill FROM maes
),
{SQL_DELTAS}"""
SQL_ENDPOINT = f"""
SELECT round(max(s_id) FILTER (replicate = 0), 6) AS s_id, round(max(s_ood) FILTER (replicate = 0), 6) AS s_ood, round(max(delta) FILTER (replicate = 0), 6) AS delta,
  round(quantile_cont(delta, 0.025) FILTER (replicate > 0), 6) AS ci_low, round(quantile_cont(delta, 0.975) FILTER (replicate > 0), 6) AS ci_high,
  sum(n_undefined)::BIGINT AS n_undefined, (SELECT n_misplaced FROM misplaced) AS n_misplaced, '{{name}}' AS recalibration, 10 AS repeats, 5 AS n_folds, {B} AS resamples, 2026 AS bootstrap_seed, {{verdict}} AS verdict FROM deltas
"""
DEPLOYED = "q_hat"
OLS = "(intercept + slope * q_hat)"


def endpoint(spark, sf_dir, recalibrator, resamples=B, seeds=SEEDS, digits=6):
    units = scored_suppliers(spark, sf_dir).select("domain", "unit_id", "q_true", "q_hat")
    out = endpoints.shift_endpoint(
        units, "domain", "unit_id", "q_true", "q_hat", IN_DOMAIN, OUT_DOMAIN, recalibrator=recalibrator, seeds=seeds, resamples=resamples
    )
    return rounded(out, "s_id", "s_ood", "delta", "ci_low", "ci_high", digits=digits)


@query("G2_deployed_endpoint", SQL_BOOT_SKILL.format(model=DEPLOYED) + SQL_ENDPOINT.format(
    name="NONE", verdict="CASE WHEN sum(n_undefined) > 0 THEN 'INVALID' WHEN quantile_cont(delta, 0.975) FILTER (replicate > 0) < 0 THEN 'POSITIVE' ELSE 'UNRESOLVED' END"))
def deployed_endpoint(spark, sf_dir):
    return endpoint(spark, sf_dir, None)


@query("G3_recoverable_skill", SQL_BOOT_SKILL.format(model=OLS) + """SELECT domain, replicate::INT AS replicate, repeat, round(model_mae, 6) AS model_mae,
round(comparator_mae, 6) AS comparator_mae, round(skill, 6) AS skill FROM skills""")
def recoverable_skill(spark, sf_dir):
    return rounded(samples(spark, sf_dir, B, scored_suppliers).skills("affine_OLS").drop("n_misplaced"), "model_mae", "comparator_mae", "skill")


@query("G4_recoverable_endpoint_ols", SQL_BOOT_SKILL.format(model=OLS) + SQL_ENDPOINT.format(name="affine_OLS", verdict="NULL::VARCHAR"))
def recoverable_endpoint_ols(spark, sf_dir):
    return endpoint(spark, sf_dir, "affine_OLS")


REPLICATE_FIT = ("domain", "replicate", "repeat", "fold")
SQL_BOOT_TRAIN = f"""
WITH RECURSIVE {SQL_SUPPLIERS}, {sql_folds('scored')}, {sql_bootstrap('scored', B)}, {SQL_MISPLACED},
v AS (SELECT b.domain, b.replicate, f.repeat, f.fold, b.m, s.q_hat AS x, s.q_true AS y FROM boot b JOIN scored s USING (unit_id) JOIN folds f USING (unit_id)),
train AS (SELECT v.domain, v.replicate, v.repeat, h.heldout AS fold, v.x, v.y, v.m FROM v, (SELECT unnest(range(0, 5)) AS heldout) h WHERE v.fold <> h.heldout),
medians AS (SELECT domain, replicate, repeat, fold, median(y) AS median FROM (SELECT *, unnest(range(m)) FROM train) GROUP BY ALL)
"""
SQL_BOOT_L1 = SQL_BOOT_TRAIN + f""",
start AS (SELECT domain, replicate, repeat, fold, regr_intercept(y, x) AS a, regr_slope(y, x) AS b FROM (SELECT *, unnest(range(m)) FROM train) GROUP BY ALL),
{sql_lad('train', REPLICATE_FIT, 'start')},
skills AS (
  SELECT v.domain, v.replicate, v.repeat,
    CASE WHEN count(*) FILTER (median IS NULL OR l.a IS NULL) = 0 AND sum(v.m * abs(median - y)) > 0 THEN 1 - sum(v.m * abs(l.a + l.b * x - y)) / sum(v.m * abs(median - y)) END AS skill
  FROM v LEFT JOIN (SELECT * FROM lad WHERE step = 80) l ON l.domain = v.domain AND l.replicate = v.replicate AND l.repeat = v.repeat AND l.fold = v.fold
  LEFT JOIN medians d ON d.domain = v.domain AND d.replicate = v.replicate AND d.repeat = v.repeat AND d.fold = v.fold GROUP BY v.domain, v.replicate, v.repeat
),
{SQL_DELTAS}"""
SQL_BOOT_ISOTONIC = SQL_BOOT_TRAIN + f""",
{sql_isotonic('train', REPLICATE_FIT)},
fitted AS ({sql_interpolated('v', REPLICATE_FIT, 'a.m, a.y')}),
skills AS (
  SELECT v.domain, v.replicate, v.repeat,
    CASE WHEN count(*) FILTER (median IS NULL) = 0 AND sum(v.m * abs(median - y)) > 0 THEN 1 - sum(v.m * abs(prediction - y)) / sum(v.m * abs(median - y)) END AS skill
  FROM fitted v LEFT JOIN medians d ON d.domain = v.domain AND d.replicate = v.replicate AND d.repeat = v.repeat AND d.fold = v.fold GROUP BY v.domain, v.replicate, v.repeat
),
{SQL_DELTAS}"""


@query("G4_recoverable_endpoint_l1", SQL_BOOT_L1 + SQL_ENDPOINT.replace(", 6)", ", 4)").format(
    name="affine_L1", verdict="CASE WHEN sum(n_undefined) > 0 THEN 'INVALID' WHEN quantile_cont(delta, 0.975) FILTER (replicate > 0) < 0 THEN 'REPLICATED' ELSE 'UNRESOLVED' END"))
def recoverable_endpoint_l1(spark, sf_dir):
    return endpoint(spark, sf_dir, "affine_L1", digits=4)


@query("G4_recoverable_endpoint_isotonic", SQL_BOOT_ISOTONIC + SQL_ENDPOINT.format(name="isotonic", verdict="NULL::VARCHAR"))
def recoverable_endpoint_isotonic(spark, sf_dir):
    return endpoint(spark, sf_dir, "isotonic")


@query("G5_directional_verdict", f"""WITH {SQL_SCORED}, ci AS (SELECT grp, role, quantile_cont(q_hat - q_true, 0.025) AS lo, quantile_cont(q_hat - q_true, 0.3) AS hi FROM scored GROUP BY 1, 2)
SELECT grp, role, CASE WHEN lo > hi THEN 'INVALID' WHEN hi < 0 THEN 'POSITIVE' ELSE 'UNRESOLVED' END AS verdict FROM ci""")
def directional_verdict(spark, sf_dir):
    errors = scored(spark, sf_dir).withColumn("e", F.col("q_hat") - F.col("q_true"))
    ci = quantiles(errors, ["grp", "role"], "e", {"lo": 0.025, "hi": 0.3})
    return ci.select("grp", "role", endpoints.directional_verdict(F.col("lo"), F.col("hi")).alias("verdict"))


@query("G6_aggregate_gate", """WITH m AS (SELECT round(avg(1 - l_discount), 12) AS a, round(avg(1 - l_tax), 12) AS b, round(avg(l_quantity / 50), 12) AS c FROM lineitem)
SELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round((a + b + c) / 3, 6) AS macro_mean, round((a + b + c) / 3, 12) >= 0.8 AND least(a, b, c) >= 0.6 AS passed FROM m""")
def aggregate_gate(spark, sf_dir):
    shares = table(spark, sf_dir, "lineitem").select(
        (1 - F.col("l_discount")).alias("a"), (1 - F.col("l_tax")).alias("b"), (F.col("l_quantity") / 50).alias("c")
    )
    return rounded(endpoints.aggregate_gate(shares, ["a", "b", "c"]), "a", "b", "c", "macro_mean")


def _sql_point(name: str, model: str) -> str:
    return f"""SELECT '{name}' AS name, domain, avg(skill) AS s FROM (
    SELECT a.domain, a.repeat, 1 - avg(abs({model} - a.y)) / avg(abs(d.median - a.y)) AS skill
    FROM fitted a JOIN medians d ON d.domain = a.domain AND d.repeat = a.repeat AND d.fold = a.fold
    JOIN ols o ON o.domain = a.domain AND o.repeat = a.repeat AND o.fold = a.fold
    JOIN (SELECT * FROM lad WHERE step = 80) l ON l.domain = a.domain AND l.repeat = a.repeat AND l.fold = a.fold GROUP BY ALL) GROUP BY domain"""


POINT_MODELS = {"R5": "a.x", "R8_affine_L1": "(l.a + l.b * a.x)", "R8_affine_OLS": "(o.intercept + o.slope * a.x)", "R8_isotonic": "a.prediction"}
SQL_POINTS = f"""
WITH RECURSIVE {SQL_SCORED}, {sql_folds('scored')}, {SQL_MEDIANS}, {SQL_OLS}, {SQL_TRAIN}, {sql_isotonic('train', FIT)},
start AS (SELECT domain, repeat, fold, intercept AS a, slope AS b FROM ols), {sql_lad('train', FIT, 'start')},
fitted AS ({sql_interpolated('asks', FIT, 'a.x, a.y')}),
points AS ({" UNION ALL ".join(_sql_point(n, m) for n, m in POINT_MODELS.items())}),
wide AS (SELECT name, max(s) FILTER (domain = 'ID') AS s_id, max(s) FILTER (domain = 'OOD') AS s_ood FROM points GROUP BY name)
SELECT name || '.S_ID' AS metric, round(s_id, 6) AS value FROM wide UNION ALL SELECT name || '.S_OOD', round(s_ood, 6) FROM wide UNION ALL SELECT name || '.Delta', round(s_ood - s_id, 6) FROM wide"""


@query("G7_point_estimates", SQL_POINTS)
def point_estimates(spark, sf_dir):
    names = {"R5": None, "R8_affine_L1": "affine_L1", "R8_affine_OLS": "affine_OLS", "R8_isotonic": "isotonic"}
    return rounded(endpoints.point_estimates(samples(spark, sf_dir), IN_DOMAIN, OUT_DOMAIN, names), "value")
