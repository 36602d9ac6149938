"""Queries of the element-level family (K)."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import elements as el
from driftgauge.plans.bindings import CLASSES, LABELS, SQL_ELEMENTS, elements, probabilities
from driftgauge.plans.registry import query

FG = (1, 2, 3)
GRID = ("x", "y", "z")
SPACING = (1.5, 2.0, 2.5)


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


@query("K0_grid_alignment", f"""WITH {SQL_ELEMENTS} SELECT case_id, count(*) FILTER (intensity > 0 AND pred = 0) AS only_reference, count(*) FILTER (intensity = 0 AND pred > 0) AS only_prediction, 0::BIGINT AS repeated
FROM elements GROUP BY 1 HAVING count(*) FILTER ((intensity > 0) <> (pred > 0)) > 0""")
def grid_alignment(spark, sf_dir):
    grid = elements(spark, sf_dir)
    return el.grid_violations(grid.where("intensity > 0"), grid.where("pred > 0"), "case_id")


SQL_DICE = "CASE WHEN n_ref + n_pred = 0 THEN 1 ELSE 2.0 * n_both / (n_ref + n_pred) END"


@query("K1_binary_dice", f"""WITH {SQL_ELEMENTS}, c AS (SELECT case_id, count(*) FILTER (ref = 1 AND pred = 1) AS n_both, count(*) FILTER (ref = 1) AS n_ref, count(*) FILTER (pred = 1) AS n_pred FROM elements GROUP BY 1)
SELECT *, round({SQL_DICE}, 6) AS dice FROM c""")
def binary_dice(spark, sf_dir):
    return rounded(el.dice_binary(elements(spark, sf_dir), "case_id", F.col("ref") == 1, F.col("pred") == 1), "dice")


SQL_PER_LABEL = """per_label AS (SELECT case_id, label, count(*) FILTER (ref = label AND pred = label) AS n_both, count(*) FILTER (ref = label) AS n_ref, count(*) FILTER (pred = label) AS n_pred
  FROM elements, (SELECT unnest([1, 2, 3]) AS label) GROUP BY 1, 2)"""


@query("K2_dice_per_label", f"WITH {SQL_ELEMENTS}, {SQL_PER_LABEL} SELECT *, round({SQL_DICE}, 6) AS dice FROM per_label")
def dice_per_label(spark, sf_dir):
    return rounded(el.dice_per_label(elements(spark, sf_dir), "case_id", "ref", "pred", FG), "dice")


@query("K3_macro_dice", f"WITH {SQL_ELEMENTS}, {SQL_PER_LABEL} SELECT case_id, round(avg({SQL_DICE}), 6) AS dice_macro FROM per_label GROUP BY 1")
def macro_dice(spark, sf_dir):
    per_label = el.dice_per_label(elements(spark, sf_dir), "case_id", "ref", "pred", FG)
    return rounded(el.macro_dice(per_label, "case_id"), "dice_macro")


@query("K4_merged_dice", f"""WITH {SQL_ELEMENTS}, c AS (SELECT case_id, count(*) FILTER (ref IN (1, 2, 3) AND pred IN (1, 2, 3)) AS n_both, count(*) FILTER (ref IN (1, 2, 3)) AS n_ref,
  count(*) FILTER (pred IN (1, 2, 3)) AS n_pred FROM elements GROUP BY 1) SELECT *, round({SQL_DICE}, 6) AS dice FROM c""")
def merged_dice(spark, sf_dir):
    grid = elements(spark, sf_dir)
    return rounded(el.dice_binary(grid, "case_id", F.col("ref").isin(*FG), F.col("pred").isin(*FG)), "dice")


@query("K5_strict_dice", f"WITH {SQL_ELEMENTS}, {SQL_PER_LABEL} SELECT *, CASE WHEN n_ref > 0 THEN round(2.0 * n_both / (n_ref + n_pred), 6) ELSE -1 END AS dice FROM per_label")
def strict_dice(spark, sf_dir):
    per_label = el.dice_per_label(elements(spark, sf_dir), "case_id", "ref", "pred", FG, strict=True)
    return per_label.withColumn("dice", F.coalesce(F.round("dice", 6), F.lit(-1.0)))


@query("K5_empty_truth", f"""WITH {SQL_ELEMENTS}, {SQL_PER_LABEL} SELECT 'empty_truth' AS "check", case_id::VARCHAR AS key, 'label ' || label AS detail FROM per_label WHERE n_ref = 0""")
def empty_truth(spark, sf_dir):
    return el.empty_truth_violations(el.dice_per_label(elements(spark, sf_dir), "case_id", "ref", "pred", FG), "case_id")


SQL_SURFACE = """
inside AS (SELECT case_id, x, y, z, ref > 0 AS r, pred > 0 AS p FROM elements),
rmask AS (SELECT case_id, x, y, z FROM inside WHERE r), pmask AS (SELECT case_id, x, y, z FROM inside WHERE p),
rsurf AS (SELECT m.case_id, m.x, m.y, m.z FROM rmask m LEFT JOIN rmask n ON n.case_id = m.case_id AND abs(n.x - m.x) + abs(n.y - m.y) + abs(n.z - m.z) = 1 GROUP BY ALL HAVING count(n.x) < 6),
psurf AS (SELECT m.case_id, m.x, m.y, m.z FROM pmask m LEFT JOIN pmask n ON n.case_id = m.case_id AND abs(n.x - m.x) + abs(n.y - m.y) + abs(n.z - m.z) = 1 GROUP BY ALL HAVING count(n.x) < 6)
"""


@query("K6_surface", f"WITH {SQL_ELEMENTS}, {SQL_SURFACE} SELECT * FROM rsurf")
def surface(spark, sf_dir):
    return el.surface(elements(spark, sf_dir).where("ref > 0"), "case_id", GRID)


SQL_GAP = "sqrt(2.25 * (a.x - b.x) * (a.x - b.x) + 4.0 * (a.y - b.y) * (a.y - b.y) + 6.25 * (a.z - b.z) * (a.z - b.z))"
SQL_HD = f"""
pooled AS (
  SELECT a.case_id, a.x, a.y, a.z, 0 AS side, min({SQL_GAP}) AS d FROM psurf a JOIN rsurf b USING (case_id) GROUP BY ALL
  UNION ALL SELECT a.case_id, a.x, a.y, a.z, 1, min({SQL_GAP}) FROM rsurf a JOIN psurf b USING (case_id) GROUP BY ALL),
hd AS (SELECT case_id, quantile_cont(d, 0.95) AS hd FROM pooled GROUP BY 1),
distances AS (SELECT c.case_id, CASE WHEN has_r AND has_p THEN round(hd, 6) WHEN has_r OR has_p THEN -1 ELSE -2 END AS hd95
  FROM (SELECT case_id, bool_or(r) AS has_r, bool_or(p) AS has_p FROM inside GROUP BY 1) c LEFT JOIN hd USING (case_id))
"""


def readable(column: str):
    """-1 for infinity and -2 for NaN, which compare badly across engines."""
    return F.when(F.isnan(column), -2.0).when(F.col(column) == float("inf"), -1.0).otherwise(F.round(column, 6))


@query("K7_surface_distance", f"WITH {SQL_ELEMENTS}, {SQL_SURFACE}, {SQL_HD} SELECT * FROM distances")
def surface_distance(spark, sf_dir):
    grid = elements(spark, sf_dir)
    out = el.surface_distance(grid, "case_id", F.col("ref") > 0, F.col("pred") > 0, SPACING, coords=GRID)
    return out.select("case_id", readable("hd").alias("hd95"))


@query("K8_case_metrics", f"""WITH {SQL_ELEMENTS}, {SQL_PER_LABEL}, {SQL_SURFACE}, {SQL_HD}, d AS (SELECT case_id, label, {SQL_DICE} AS dice FROM per_label),
w AS (SELECT case_id, {SQL_DICE} AS dice_whole FROM (SELECT case_id, count(*) FILTER (ref > 0 AND pred > 0) AS n_both, count(*) FILTER (ref > 0) AS n_ref, count(*) FILTER (pred > 0) AS n_pred FROM elements GROUP BY 1))
SELECT case_id, round(max(dice) FILTER (label = 1), 6) AS dice_1, round(max(dice) FILTER (label = 2), 6) AS dice_2, round(max(dice) FILTER (label = 3), 6) AS dice_3,
  round(avg(dice), 6) AS dice_macro, round(any_value(dice_whole), 6) AS dice_whole, any_value(hd95) AS hd95 FROM d JOIN w USING (case_id) JOIN distances USING (case_id) GROUP BY 1""")
def case_metrics(spark, sf_dir):
    out = el.case_metrics(elements(spark, sf_dir), "case_id", "ref", "pred", LABELS, SPACING, GRID)
    return rounded(out, "dice_1", "dice_2", "dice_3", "dice_macro", "dice_whole").withColumn("hd95", readable("hd95"))


@query("K9_support", f"WITH {SQL_ELEMENTS} SELECT case_id, count(*) FILTER (intensity <> 0) AS n_support, count(*) AS n_elements FROM elements GROUP BY 1")
def support(spark, sf_dir):
    return el.support_counts(elements(spark, sf_dir), "case_id", "intensity")


@query("K10_probability_violations", f"""WITH {SQL_ELEMENTS}, bad AS (SELECT case_id, CASE WHEN x = 0 THEN 'sum_not_one' WHEN x = 1 THEN 'outside_unit_interval' ELSE 'shape' END AS rule FROM labelled WHERE x < 3)
SELECT case_id, rule, count(*) AS n FROM bad GROUP BY 1, 2""")
def probability_violations(spark, sf_dir):
    """The grid's vectors with one row each spoiled in three ways; the fourth row stays valid."""
    spoiled = probabilities(spark, sf_dir).withColumn(
        "p",
        F.when(F.col("x") == 0, F.transform("p", lambda v: v * 0.5))
        .when(F.col("x") == 1, F.concat(F.slice("p", 1, 3), F.array(F.lit(1.5))))
        .when(F.col("x") == 2, F.slice("p", 1, 3))
        .otherwise(F.col("p")),
    )
    return el.probability_violations(spoiled, "case_id", "p", CLASSES)


@query("K11_label_violations", f"WITH {SQL_ELEMENTS} SELECT case_id, pred, count(*) AS n FROM elements WHERE pred NOT IN (0, 1, 2) GROUP BY 1, 2")
def label_violations(spark, sf_dir):
    return el.label_violations(elements(spark, sf_dir), "case_id", "pred", (0, 1, 2))


SQL_PROB = """round(avg(entropy), 6) AS entropy_mean, round(quantile_cont(entropy, 0.9), 6) AS entropy_p90, round(quantile_cont(entropy, 0.95), 6) AS entropy_p95,
  round(avg(conf), 6) AS confidence_mean, round(quantile_cont(conf, 0.1), 6) AS confidence_p10"""
PROB = ("entropy_mean", "entropy_p90", "entropy_p95", "confidence_mean", "confidence_p10")


@query("K12_probability_features", f"WITH {SQL_ELEMENTS} SELECT case_id, {SQL_PROB} FROM elements WHERE intensity <> 0 GROUP BY 1")
def probability_features(spark, sf_dir):
    return rounded(el.probability_features(elements(spark, sf_dir), "case_id", "p", el.in_support("intensity")), *PROB)


@query("K13_argmax_label", f"WITH {SQL_ELEMENTS} SELECT case_id, x, y, z, pred AS label FROM labelled")
def argmax_label(spark, sf_dir):
    return el.with_argmax(probabilities(spark, sf_dir), "p").select("case_id", "x", "y", "z", "label")


SQL_FRACTIONS = "round(count(*) FILTER (pred > 0) / count(*), 6) AS foreground_fraction, " + ", ".join(
    f"round(count(*) FILTER (pred = {v}) / count(*), 6) AS class_fraction_{v}" for v in FG
)
FRACTIONS = ("foreground_fraction", *[f"class_fraction_{v}" for v in FG])


@query("K14_label_fractions", f"WITH {SQL_ELEMENTS} SELECT case_id, {SQL_FRACTIONS} FROM elements WHERE intensity <> 0 GROUP BY 1")
def label_fractions(spark, sf_dir):
    out = el.label_fractions(elements(spark, sf_dir), "case_id", "pred", LABELS, el.in_support("intensity"))
    return rounded(out, *FRACTIONS)


def sql_components(source: str) -> str:
    return f"""
nodes AS (SELECT case_id, pred AS label, x, y, z, x::BIGINT * 1048576 * 1048576 + y::BIGINT * 1048576 + z AS code FROM {source} WHERE pred > 0),
reach AS (
  SELECT case_id, label, code, x, y, z, code AS root FROM nodes
  UNION SELECT r.case_id, r.label, n.code, n.x, n.y, n.z, r.root FROM reach r JOIN nodes n ON n.case_id = r.case_id AND n.label = r.label AND abs(n.x - r.x) <= 1 AND abs(n.y - r.y) <= 1 AND abs(n.z - r.z) <= 1
),
member AS (SELECT case_id, label, code, min(root) AS component FROM reach GROUP BY 1, 2, 3),
sizes AS (SELECT case_id, label, component, count(*) AS n FROM member GROUP BY 1, 2, 3),
counted AS (SELECT case_id, label, count(*) AS components, max(n) / sum(n) AS largest FROM sizes GROUP BY 1, 2)
"""


@query("K15_components", f"""WITH RECURSIVE {SQL_ELEMENTS}, {sql_components('elements')}
SELECT c.case_id, l.label, coalesce(components, 0) AS components, round(coalesce(largest, 0), 6) AS largest_fraction
FROM (SELECT DISTINCT case_id FROM elements) c CROSS JOIN (SELECT unnest([1, 2, 3]) AS label) l LEFT JOIN counted k ON k.case_id = c.case_id AND k.label = l.label""")
def components(spark, sf_dir):
    grid = elements(spark, sf_dir)
    found = el.connected_components(grid.where("pred > 0"), "case_id", "pred")
    return rounded(el.component_features(found, grid.select("case_id").distinct(), "case_id", FG), "largest_fraction")


@query("K15_components_tiled", f"""WITH RECURSIVE {SQL_ELEMENTS}, {sql_components('elements')} SELECT case_id, label, component, n FROM sizes""")
def components_tiled(spark, sf_dir):
    """Tiles of two elements force the contraction across tile faces."""
    found = el.connected_components(elements(spark, sf_dir).where("pred > 0"), "case_id", "pred", tile=2)
    return found.groupBy("case_id", "label", "component").agg(F.count(F.lit(1)).alias("n"))


SQL_WIDE = """wide AS (SELECT case_id, """ + ", ".join(
    f"coalesce(max(components) FILTER (label = {v}), 0)::DOUBLE AS components_{v}, round(coalesce(max(largest) FILTER (label = {v}), 0), 6) AS largest_component_fraction_{v}" for v in FG
) + " FROM counted GROUP BY 1)"
SQL_COMPONENT_COLUMNS = ", ".join(f"coalesce(w.components_{v}, 0) AS components_{v}, coalesce(w.largest_component_fraction_{v}, 0) AS largest_component_fraction_{v}" for v in FG)


def _sql_features(source: str, where: str) -> str:
    return f"""WITH RECURSIVE {SQL_ELEMENTS}, {sql_components(source)}, {SQL_WIDE},
base AS (SELECT case_id, {SQL_PROB}, {SQL_FRACTIONS} FROM {source} {where} GROUP BY 1)
SELECT b.*, {SQL_COMPONENT_COLUMNS} FROM base b LEFT JOIN wide w USING (case_id)"""


@query("K16_features_with_support", _sql_features("elements", "WHERE intensity <> 0"))
def features_with_support(spark, sf_dir):
    out = el.case_features(elements(spark, sf_dir), "case_id", "p", "pred", LABELS, support=el.in_support("intensity"))
    return rounded(out, *[c for c in out.columns if c != "case_id"])


@query("K17_features_all_elements", _sql_features("labelled", ""))
def features_all_elements(spark, sf_dir):
    grid = el.with_argmax(probabilities(spark, sf_dir), "p")
    out = el.case_features(grid, "case_id", "p", "label", LABELS)
    return rounded(out, *[c for c in out.columns if c != "case_id"])
