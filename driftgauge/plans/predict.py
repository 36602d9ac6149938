"""Queries of the predictor, conformal and support families (H to J)."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import conformal, models, support
from driftgauge.operators.contracts import population_violations
from driftgauge.operators.resample import repeated_folds
from driftgauge.plans.bindings import FEATURES, SQL_FEATURES, SQL_SCORED, feature_table, features, scored, sql_folds, table
from driftgauge.plans.registry import query

ALPHAS = conformal.ALPHA_LEVELS


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- H: predictors -----------------------------------------------------------------------


@query("H1_mean_baseline", f"""WITH {SQL_SCORED}, {SQL_FEATURES} SELECT unit_id, split, round((SELECT avg(target) FROM features WHERE split = 'QC_TRAIN'), 6) AS mean_pred FROM features""")
def mean_baseline(spark, sf_dir):
    df = features(spark, sf_dir)
    mean = models.train_mean(df, F.col("split") == "QC_TRAIN", "target")
    return df.select("unit_id", "split", F.round(F.lit(mean), 6).alias("mean_pred"))


SQL_Z = ", ".join(f"round((f.{c} - m.m_{c}) / (CASE WHEN m.s_{c} = 0 THEN 1 ELSE m.s_{c} END), 6) AS {c}" for c in FEATURES)
SQL_MS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURES)


@query("H2_standardize", f"WITH {SQL_SCORED}, {SQL_FEATURES}, m AS (SELECT {SQL_MS} FROM features WHERE split = 'QC_TRAIN') SELECT f.unit_id, {SQL_Z} FROM features f, m")
def standardize(spark, sf_dir):
    df = features(spark, sf_dir)
    means, scales = models.standardization(df.where("split = 'QC_TRAIN'"), FEATURES)
    return rounded(models.standardized(df.select("unit_id", *FEATURES), FEATURES, means, scales), *FEATURES)


def training(spark, sf_dir):
    return feature_table(spark, sf_dir).where("split = 'QC_TRAIN'")


def sql_solved(name: str, source: str, keys: str, size: int, width: int) -> str:
    """CTE ``name(keys, p, mat)``: Gauss-Jordan steps on the matrices (lists of rows of ``width``) of ``source(keys, mat)``; the last step has ``p = size``."""
    return f"""
{name} AS (
  SELECT {keys}, 0 AS p, mat FROM {source}
  UNION ALL
  SELECT {keys}, p + 1, list_transform(mat, lambda r, i: CASE WHEN i = p + 1 THEN list_transform(r, lambda v: v / mat[p + 1][p + 1])
    ELSE list_transform(range(1, {width + 1}), lambda j: r[j] - r[p + 1] * mat[p + 1][j] / mat[p + 1][p + 1]) END) FROM {name} WHERE p < {size})"""


# Ridge in SQL: standardised Gram matrices of the rows outside each fold (held = -1: of all rows), one linear system per fold and penalty.
N_FEATURES = len(FEATURES)
SQL_ALPHAS = ", ".join(f"{a!r}::DOUBLE" for a in models.ALPHA_GRID)
SQL_FIT_Z = "[" + ", ".join(f"({c} - m_{c}) / (CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END)" for c in FEATURES) + "]"
SQL_RIDGE = f"""
WITH RECURSIVE {SQL_SCORED}, {SQL_FEATURES}, units AS (SELECT 'all' AS domain, unit_id FROM features WHERE split = 'QC_TRAIN'), {sql_folds('units', (models.CV_SEED,))},
tf AS (SELECT t.*, f.fold FROM features t JOIN folds f USING (unit_id)),
st AS (SELECT held, avg(target) AS m_y, {SQL_MS} FROM tf JOIN (SELECT unnest(range(-1, 5)) AS held) h ON fold <> held GROUP BY held),
zt AS (SELECT held, {SQL_FIT_Z} AS z, target - m_y AS y FROM tf JOIN st ON fold <> held),
gm AS (SELECT held, i, j, sum(z[i] * CASE WHEN j > {N_FEATURES} THEN y ELSE z[j] END) AS v
  FROM zt, (SELECT unnest(range(1, {N_FEATURES + 1})) AS i) a, (SELECT unnest(range(1, {N_FEATURES + 2})) AS j) b GROUP BY held, i, j),
penalised AS (SELECT held, alpha, i, list(v + CASE WHEN i = j THEN alpha ELSE 0 END ORDER BY j) AS r FROM gm, (SELECT unnest([{SQL_ALPHAS}]) AS alpha) GROUP BY held, alpha, i),
systems AS (SELECT held, alpha, list(r ORDER BY i) AS mat FROM penalised GROUP BY held, alpha),
{sql_solved('gj', 'systems', 'held, alpha', N_FEATURES, N_FEATURES + 1)},
beta AS (SELECT held, alpha, list_transform(mat, lambda r: r[{N_FEATURES + 1}]) AS b FROM gj WHERE p = {N_FEATURES}),
err AS (SELECT alpha, fold, avg(abs(m_y + list_dot_product(b, {SQL_FIT_Z}) - target)) AS mae FROM tf JOIN st ON held = fold JOIN beta USING (held) GROUP BY alpha, fold),
best AS (SELECT alpha, avg(mae) AS mean_mae FROM err GROUP BY alpha ORDER BY mean_mae, alpha LIMIT 1)
"""
SQL_MODEL = SQL_RIDGE + "\n UNION ALL ".join([""] + [
    f"""SELECT {i} AS position, '{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS scale, round(b[{i + 1}], 6) AS coefficient, round(m_y, 6) AS intercept, alpha
  FROM best JOIN beta USING (alpha) JOIN st USING (held) WHERE held = -1""" for i, c in enumerate(FEATURES)
]).replace("\n UNION ALL ", "", 1)


@query("H3_ridge_search", SQL_MODEL)
def ridge_search(spark, sf_dir):
    model = models.ridge_search(training(spark, sf_dir), "unit_id", FEATURES, "target").model
    return rounded(model.table(spark), "mean", "scale", "coefficient", "intercept")


SHRINK = (0.0, 0.25, 0.5, 0.75, 1.0)


@query("H4_cv_provenance", f"""WITH {SQL_SCORED}, {sql_folds('scored')}, f AS (
  SELECT alpha, fold, avg(abs(alpha * q_hat + (1 - alpha) * 0.5 - q_true)) AS mae FROM scored JOIN folds USING (unit_id), (VALUES (0.0::DOUBLE), (0.25), (0.5), (0.75), (1.0)) a(alpha)
  WHERE repeat = 0 GROUP BY 1, 2),
t AS (SELECT alpha, count(*) AS n_folds, avg(mae) AS mean_mae, stddev_pop(mae) AS sd_mae FROM f GROUP BY 1)
SELECT alpha, n_folds, round(mean_mae, 6) AS mean_mae, round(sd_mae, 6) AS sd_mae, rank() OVER (ORDER BY mean_mae)::INT AS rank FROM t""")
def cv_provenance(spark, sf_dir):
    """Shrinking q_hat towards one half by alpha stands for the penalty, so plain SQL can follow."""
    units = repeated_folds(scored(spark, sf_dir), ["domain"], "unit_id", [2026])
    alphas = F.explode(F.array(*[F.lit(a) for a in SHRINK]))
    scores = (
        units.select(F.element_at("folds", 1).alias("fold"), "q_hat", "q_true", alphas.alias("alpha"))
        .groupBy("alpha", "fold")
        .agg(F.avg(F.abs(F.col("alpha") * F.col("q_hat") + (1 - F.col("alpha")) * 0.5 - F.col("q_true"))).alias("mae"))
    )
    return rounded(models.cv_provenance(scores), "mean_mae", "sd_mae")


@query("H4_ridge_cv_provenance", SQL_RIDGE + """, t AS (SELECT alpha, count(*) AS n_folds, avg(mae) AS mean_mae, stddev_pop(mae) AS sd_mae FROM err GROUP BY 1)
SELECT alpha, n_folds, round(mean_mae, 6) AS mean_mae, round(sd_mae, 6) AS sd_mae, rank() OVER (ORDER BY mean_mae)::INT AS rank FROM t""")
def ridge_cv_provenance(spark, sf_dir):
    search = models.ridge_search(training(spark, sf_dir), "unit_id", FEATURES, "target")
    return rounded(models.cv_provenance(search.fold_scores), "mean_mae", "sd_mae")


@query("H4_selected_penalty", SQL_RIDGE + "SELECT alpha, fold::INT AS fold, round(mae, 6) AS mae, round(mean_mae, 6) AS mean_mae FROM err JOIN best USING (alpha)")
def selected_penalty(spark, sf_dir):
    search = models.ridge_search(training(spark, sf_dir), "unit_id", FEATURES, "target")
    return rounded(models.selected_penalty(search.fold_scores), "mae", "mean_mae")


@query("H5_boosted_trees")
def boosted_trees(spark, sf_dir):
    df = feature_table(spark, sf_dir)
    model = models.boosted_trees(df.where("split = 'QC_TRAIN'"), FEATURES, "target")
    return rounded(models.predict_trees(df, model, FEATURES, "trees_pred").select("unit_id", "split", "trees_pred"), "trees_pred")


@query("H6_fit_baselines")
def fit_baselines(spark, sf_dir):
    df = feature_table(spark, sf_dir)
    fitted = models.fit_baselines(df, "unit_id", "split", "QC_TRAIN", FEATURES, "target")
    out = models.predict_baselines(df.select("unit_id", "split", *FEATURES, "target"), fitted, "target", ["split", "unit_id"])
    names = [f"{m}_{kind}" for m in ("mean", "ridge", "trees") for kind in ("pred", "abs_error")]
    return rounded(out.select("unit_id", "split", *names), *names)


@query("H7_fit_deployed", SQL_MODEL)
def fit_deployed(spark, sf_dir):
    model = models.fit_deployed(training(spark, sf_dir), "unit_id", "split", "QC_TRAIN", FEATURES, "target")
    return rounded(model.table(spark), "mean", "scale", "coefficient", "intercept")


@query("H7_population_guard", f"""WITH {SQL_SCORED} SELECT 'population' AS "check", 'AFRICA' AS key, unnest(['several populations', 'wrong population']) AS detail""")
def population_guard(spark, sf_dir):
    """Five regions where one was promised: the fit is refused with these violations."""
    return population_violations(scored(spark, sf_dir), "grp", "unit_id", "EUROPE")


@query("H8_score", SQL_RIDGE + f"SELECT f.unit_id, round(m_y + list_dot_product(b, {SQL_FIT_Z}), 6) AS q_hat FROM features f, (SELECT * FROM best JOIN beta USING (alpha) JOIN st USING (held) WHERE held = -1)")
def score(spark, sf_dir):
    """The model fitted on the training split scores every unit from all its features."""
    df = feature_table(spark, sf_dir)
    model = models.fit_deployed(df.where("split = 'QC_TRAIN'"), "unit_id", "split", "QC_TRAIN", FEATURES, "target")
    return df.select("unit_id", F.round(model.score(), 6).alias("q_hat"))


# --- I: split-conformal ---------------------------------------------------------------------

SQL_CAL = "cal AS (SELECT *, abs(q_true - q_hat) AS residual FROM scored WHERE role = 'CALIBRATION')"
SQL_LEVELS = "levels AS (SELECT unnest([0.2::DOUBLE, 0.1::DOUBLE, 0.05::DOUBLE]) AS alpha)"
SQL_THRESHOLDS = """
ordered AS (SELECT domain, residual, row_number() OVER (PARTITION BY domain ORDER BY residual) AS k, count(*) OVER (PARTITION BY domain) AS n FROM cal),
thresholds AS (SELECT domain, alpha, n, k AS rank, residual AS threshold FROM ordered, levels WHERE k = ceil((n + 1) * (1 - alpha))::BIGINT)
"""


def calibration(spark, sf_dir):
    return conformal.absolute_residuals(scored(spark, sf_dir).where("role = 'CALIBRATION'"), "q_true", "q_hat")


@query("I1_finite_sample_rank", f"WITH {SQL_SCORED}, {SQL_LEVELS}, n AS (SELECT grp, count(*) AS n FROM scored GROUP BY 1) SELECT grp, alpha, n, ceil((n + 1) * (1 - alpha))::BIGINT AS rank FROM n, levels")
def finite_sample_rank(spark, sf_dir):
    counts = scored(spark, sf_dir).groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    entries = [F.struct(F.lit(a).alias("alpha"), conformal.finite_sample_rank(F.col("n"), a).alias("rank")) for a in ALPHAS]
    return counts.select("grp", "n", F.explode(F.array(*entries)).alias("e")).select("grp", "n", "e.*")


@query("I2_absolute_residuals", f"WITH {SQL_SCORED}, {SQL_CAL} SELECT unit_id, round(residual, 6) AS residual FROM cal")
def absolute_residuals(spark, sf_dir):
    return calibration(spark, sf_dir).select("unit_id", F.round("residual", 6).alias("residual"))


@query("I3_residual_threshold", f"WITH {SQL_SCORED}, {SQL_CAL}, {SQL_LEVELS}, {SQL_THRESHOLDS} SELECT domain, alpha, n, rank, round(threshold, 6) AS threshold FROM thresholds")
def residual_threshold(spark, sf_dir):
    return rounded(conformal.residual_thresholds(calibration(spark, sf_dir), ["domain"], "residual"), "threshold")


SQL_INTERVALS = """
iv AS (SELECT s.domain, s.grp, s.unit_id, t.alpha, q_true, q_hat - threshold AS lower_raw, q_hat + threshold AS upper_raw,
  least(greatest(q_hat - threshold, 0), 1) AS lower, least(greatest(q_hat + threshold, 0), 1) AS upper
  FROM scored s JOIN thresholds t USING (domain) WHERE role = 'EVAL')
"""


def evaluated(spark, sf_dir):
    thresholds = conformal.residual_thresholds(calibration(spark, sf_dir), ["domain"], "residual")
    points = scored(spark, sf_dir).where("role = 'EVAL'")
    return conformal.apply_levels(points, "q_hat", thresholds, ["domain"])


@query("I4_intervals", f"""WITH {SQL_SCORED}, {SQL_CAL}, {SQL_LEVELS}, {SQL_THRESHOLDS}, {SQL_INTERVALS} SELECT unit_id, alpha, round(lower_raw, 6) AS lower_raw, round(upper_raw, 6) AS upper_raw,
  round(lower, 6) AS lower, round(upper, 6) AS upper, round(upper - lower, 6) AS width FROM iv""")
def intervals(spark, sf_dir):
    names = ["lower_raw", "upper_raw", "lower", "upper", "width"]
    return rounded(evaluated(spark, sf_dir).select("unit_id", "alpha", *names), *names)


@query("I5_interval_hits", f"WITH {SQL_SCORED}, {SQL_CAL}, {SQL_LEVELS}, {SQL_THRESHOLDS}, {SQL_INTERVALS} SELECT unit_id, alpha, q_true BETWEEN lower AND upper AS hit FROM iv")
def interval_hits(spark, sf_dir):
    return evaluated(spark, sf_dir).select("unit_id", "alpha", conformal.interval_hit("q_true").alias("hit"))


@query("I6_interval_metrics", f"""WITH {SQL_SCORED}, {SQL_CAL}, {SQL_LEVELS}, {SQL_THRESHOLDS}, {SQL_INTERVALS} SELECT domain, alpha, count(*) AS n, round(avg((q_true BETWEEN lower AND upper)::INT), 6) AS coverage,
  round(abs(avg((q_true BETWEEN lower AND upper)::INT) - (1 - alpha)), 6) AS coverage_error, round(avg(upper - lower), 6) AS mean_width, round(median(upper - lower), 6) AS median_width FROM iv GROUP BY 1, 2""")
def interval_metrics(spark, sf_dir):
    hits = evaluated(spark, sf_dir).withColumn("hit", conformal.interval_hit("q_true"))
    out = conformal.interval_metrics(hits, ["domain", "alpha"], "hit", "width", 1 - F.col("alpha"))
    return rounded(out, "coverage", "coverage_error", "mean_width", "median_width")


SQL_ONE = "cal AS (SELECT 'ID' AS domain, abs(q_true - q_hat) AS residual, unit_id FROM scored WHERE role = 'CALIBRATION' AND scored.domain = 'ID')"


@query("I7_deployed_levels", f"""WITH {SQL_SCORED}, {SQL_ONE}, {SQL_LEVELS}, {SQL_THRESHOLDS} SELECT s.unit_id, t.alpha, round(threshold, 6) AS threshold,
  round(least(greatest(q_hat - threshold, 0), 1), 6) AS lower, round(least(greatest(q_hat + threshold, 0), 1), 6) AS upper FROM scored s, thresholds t WHERE s.role = 'EVAL'""")
def deployed_levels(spark, sf_dir):
    """Thresholds from one calibration population, applied to every evaluated unit of both domains."""
    source = calibration(spark, sf_dir).where("domain = 'ID'")
    thresholds = conformal.residual_thresholds(source, ["domain"], "residual")
    points = scored(spark, sf_dir).where("role = 'EVAL'")
    out = conformal.apply_levels(points, "q_hat", thresholds)
    return rounded(out.select("unit_id", "alpha", "threshold", "lower", "upper"), "threshold", "lower", "upper")


@query("I8_unconditional_interval", f"""WITH {SQL_SCORED}, {SQL_LEVELS} SELECT domain, alpha, round(quantile_cont(q_true, 0.1) FILTER (alpha = 0.2::DOUBLE), 6) AS lower_raw,
  round(quantile_cont(q_true, 0.9) FILTER (alpha = 0.2::DOUBLE), 6) AS upper_raw FROM scored, levels WHERE role = 'CALIBRATION' AND alpha = 0.2::DOUBLE GROUP BY 1, 2
UNION ALL SELECT domain, alpha, round(quantile_cont(q_true, 0.05), 6), round(quantile_cont(q_true, 0.95), 6) FROM scored, levels WHERE role = 'CALIBRATION' AND alpha = 0.1::DOUBLE GROUP BY 1, 2
UNION ALL SELECT domain, alpha, round(quantile_cont(q_true, 0.025), 6), round(quantile_cont(q_true, 0.975), 6) FROM scored, levels WHERE role = 'CALIBRATION' AND alpha = 0.05::DOUBLE GROUP BY 1, 2""")
def unconditional_interval(spark, sf_dir):
    out = conformal.unconditional_intervals(scored(spark, sf_dir).where("role = 'CALIBRATION'"), ["domain"], "q_true")
    return rounded(out.select("domain", "alpha", "lower_raw", "upper_raw"), "lower_raw", "upper_raw")


# --- J: training support ------------------------------------------------------------------------

SOURCE_SPLITS = ("QC_TRAIN", "CALIBRATION")
SQL_REFERENCE = "reference AS (SELECT * FROM features WHERE domain = 'ID' AND split IN ('QC_TRAIN', 'CALIBRATION'))"
SQL_VEC = "[" + ", ".join(f"(f.{c} - m.m_{c}) / (CASE WHEN m.s_{c} = 0 THEN 1 ELSE m.s_{c} END)" for c in FEATURES) + "]"


def source_support(spark, sf_dir):
    df = feature_table(spark, sf_dir)
    in_source = df.where("domain = 'ID' or split = 'EVAL'")
    return in_source, support.fit_source_support(in_source, "split", "domain", SOURCE_SPLITS, "ID", FEATURES)


@query("J1_source_support", f"WITH {SQL_SCORED}, {SQL_FEATURES}, {SQL_REFERENCE}, m AS (SELECT {SQL_MS} FROM reference) SELECT f.unit_id, {SQL_Z} FROM reference f, m")
def fit_support(spark, sf_dir):
    _, fitted = source_support(spark, sf_dir)
    z = models.standardized(fitted.reference.select("unit_id", *FEATURES), FEATURES, fitted.mean, fitted.scale)
    return rounded(z, *FEATURES)


KS = (1, 5, 10)


def _sql_knn(reference: str, queries: str) -> str:
    means = ", ".join(f"round(avg(d) FILTER (k <= {k}), 6) AS support_knn_k{k}" for k in KS)
    return f"""nn AS (SELECT q.id, list_distance(q.vec, r.vec) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.vec, r.vec)) AS k
  FROM {queries} q, {reference} r)
SELECT id AS vec_id, {means} FROM nn WHERE k <= {max(KS)} GROUP BY id"""


@query("J2_knn_embeddings", f"""WITH r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE label < 5),
q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE label >= 5), {_sql_knn('r', 'q')}""")
def knn_embeddings(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    near = support.nearest_distances(vectors.where("label >= 5"), vectors.where("label < 5"), "vec_id", max(KS))
    return rounded(support.mean_distances(near, "vec_id", KS), *[f"support_knn_k{k}" for k in KS])


@query("J2_knn_embeddings_partitioned", f"""WITH r AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE label < 5),
q AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec FROM embeddings WHERE label >= 5), {_sql_knn('r', 'q')}""")
def knn_embeddings_partitioned(spark, sf_dir):
    """The same search in the form taken when the reference is too large to broadcast."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    near = support.nearest_distances(vectors.where("label >= 5"), vectors.where("label < 5"), "vec_id", max(KS), broadcast_limit=0)
    return rounded(support.mean_distances(near, "vec_id", KS), *[f"support_knn_k{k}" for k in KS])


@query("J2_knn_features", f"""WITH {SQL_SCORED}, {SQL_FEATURES}, {SQL_REFERENCE}, m AS (SELECT {SQL_MS} FROM reference),
r AS (SELECT f.unit_id AS id, {SQL_VEC} AS vec FROM reference f, m), q AS (SELECT f.unit_id AS id, {SQL_VEC} AS vec FROM features f, m WHERE f.split = 'EVAL'),
nn AS (SELECT id, list_sort(list(d)) AS ds FROM (SELECT q.id, list_distance(q.vec, r.vec) AS d FROM q, r) GROUP BY id)
SELECT id AS unit_id, round(ds[1], 6) AS support_knn_k1, round(list_avg(ds[1:5]), 6) AS support_knn_k5, round(list_avg(ds[1:10]), 6) AS support_knn_k10 FROM nn""")
def knn_features(spark, sf_dir):
    df, fitted = source_support(spark, sf_dir)
    queries = fitted.vectors(df.where("split = 'EVAL'"), "unit_id")
    near = support.nearest_distances(queries, fitted.vectors(fitted.reference, "unit_id"), "unit_id", max(KS))
    return rounded(support.mean_distances(near, "unit_id", KS), *[f"support_knn_k{k}" for k in KS])


def sql_ledoit_wolf(vectors: str, p: int) -> str:
    """CTEs over ``vectors(x)``: ``location(m)`` and ``precision(rows)`` of the shrunk covariance, inverted by Gauss-Jordan steps."""
    numbers = f"(SELECT unnest(range(1, {p + 1})) AS i) a"
    return f"""
location AS (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x[i]) AS m FROM {vectors}, {numbers} GROUP BY i)),
centred AS (SELECT list_transform(range(1, {p + 1}), lambda i: x[i] - m[i]) AS d FROM {vectors}, location),
covariance AS (SELECT i, j, avg(d[i] * d[j]) AS s FROM centred, {numbers}, (SELECT unnest(range(1, {p + 1})) AS j) b GROUP BY i, j),
moments AS (SELECT n, fourth, trace / {p} AS mu, frob, (frob - trace * trace / {p}) / {p} AS delta, (fourth / n - frob) / ({p} * n) AS beta
  FROM (SELECT count(*) AS n, sum(list_dot_product(d, d) ** 2) AS fourth FROM centred), (SELECT sum(s) FILTER (i = j) AS trace, sum(s * s) AS frob FROM covariance)),
shrunk AS (SELECT i, j, (1 - g) * s + CASE WHEN i = j THEN g * mu ELSE 0 END AS v FROM covariance, (SELECT mu, CASE WHEN beta > 0 THEN least(beta, delta) / delta ELSE 0 END AS g FROM moments)),
beside AS (SELECT 0 AS one, list(r ORDER BY i) AS mat FROM (SELECT i, list_concat(list(v ORDER BY j), list((i = j)::INT::DOUBLE ORDER BY j)) AS r FROM shrunk GROUP BY i)),
{sql_solved('inverted', 'beside', 'one', p, 2 * p)},
precision AS (SELECT list_transform(mat, lambda r: r[{p + 1}:{2 * p}]) AS rows FROM inverted WHERE p = {p})"""


def sql_mahalanobis(d: str) -> str:
    return f"list_dot_product({d}, list_transform(rows, lambda r: list_dot_product(r, {d})))"


@query("J3_mahalanobis", f"""WITH RECURSIVE vectors AS (SELECT embedding::DOUBLE[] AS x FROM embeddings WHERE label < 5), {sql_ledoit_wolf('vectors', 64)},
asks AS (SELECT vec_id, list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE - m[i]) AS d FROM embeddings, location WHERE label >= 5)
SELECT vec_id, round({sql_mahalanobis('d')}, 6) AS support_mahalanobis FROM asks, precision""")
def mahalanobis(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vec"), "label")
    fitted = support.ledoit_wolf(vectors.where("label < 5"))
    return rounded(support.mahalanobis(vectors.where("label >= 5"), fitted, "vec_id"), "support_mahalanobis")


@query("J4_support_scores", f"""WITH RECURSIVE {SQL_SCORED}, {SQL_FEATURES}, {SQL_REFERENCE}, m AS (SELECT {SQL_MS} FROM reference),
r AS (SELECT f.unit_id AS id, {SQL_VEC} AS x FROM reference f, m), q AS (SELECT f.unit_id AS id, f.domain, f.split, {SQL_VEC} AS x FROM features f, m WHERE f.split = 'EVAL'),
nn AS (SELECT id, list_sort(list(d)) AS ds FROM (SELECT q.id, list_distance(q.x, r.x) AS d FROM q, r) GROUP BY id), vectors AS (SELECT x FROM r), {sql_ledoit_wolf('vectors', N_FEATURES)},
asks AS (SELECT id, q.domain, q.split, list_transform(range(1, {N_FEATURES + 1}), lambda i: x[i] - location.m[i]) AS d FROM q, location)
SELECT id AS unit_id, domain, split, round(ds[1], 6) AS support_knn_k1, round(list_avg(ds[1:5]), 6) AS support_knn_k5, round(list_avg(ds[1:10]), 6) AS support_knn_k10,
  round({sql_mahalanobis('d')}, 6) AS support_mahalanobis FROM asks JOIN nn USING (id), precision""")
def support_scores(spark, sf_dir):
    df, fitted = source_support(spark, sf_dir)
    out = support.support_scores(df, fitted, "unit_id", "split", "domain", ["EVAL"], KS)
    return rounded(out, *[c for c in out.columns if c.startswith("support_")])


@query("J4_score_guards", "SELECT 'split' AS \"check\", vec_id::VARCHAR AS key, label::VARCHAR AS detail FROM embeddings WHERE label > 6 UNION ALL SELECT 'score', vec_id::VARCHAR, 'not finite or negative' FROM embeddings WHERE list_min(embedding) < -0.25")
def score_guards(spark, sf_dir):
    """The least of all components, moved so that some stay above zero, stands for the score."""
    least = (F.array_min("embedding") + F.lit(0.25)).cast("double")
    scores = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("split"), least.alias("support_knn_k1"))
    return support.score_violations(scores, "vec_id", "split", [str(v) for v in range(7)])
