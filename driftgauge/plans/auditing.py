"""Queries of the audit and provenance families (B and C)."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.functions import normalized_label
from driftgauge.operators import audit, provenance, resample
from driftgauge.operators.contracts import violation
from driftgauge.plans.bindings import (
    LABELS, SQL_ELEMENTS, SQL_SCORED, elements, scored, sql_folds, sql_set_digest, table,
)
from driftgauge.plans.registry import query
from driftgauge.plans.shift import SQL_QUOTA_ROLE, SQL_SEGMENTS, segment_quotas, segments, sql_place


def rounded(df, *columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- B: audit --------------------------------------------------------------------------------


@query("B1_expand_phases", """SELECT o_orderkey, phase, CASE phase WHEN 'ED' THEN day(o_orderdate) ELSE month(o_orderdate) END::INT AS phase_value, o_orderkey || '__' || phase AS case_id FROM orders, (VALUES ('ED'), ('ES')) p(phase)""")
def expand_phases(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.dayofmonth("o_orderdate").alias("ed"), F.month("o_orderdate").alias("es"))
    return audit.expand_phases(orders, {"ED": "ed", "ES": "es"}, "o_orderkey")


@query("B2_group_completeness", """WITH p AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2)
SELECT conv_id, sum(n)::BIGINT AS n_rows, count(*) AS n_phases, count(*) FILTER (role NOT IN ('user', 'assistant')) AS n_unknown, count(*) FILTER (n > 1) AS n_repeated,
  count(*) = 2 AND count(*) FILTER (role NOT IN ('user', 'assistant')) = 0 AND count(*) FILTER (n > 1) = 0 AS complete FROM p GROUP BY 1""")
def group_completeness(spark, sf_dir):
    return audit.group_completeness(table(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant"])


@query("B3_phase_means", "SELECT conv_id, count(*) AS n_phases, round(avg(length(text)), 6) AS n_chars, round(avg(turn), 6) AS turn FROM conversations GROUP BY 1")
def phase_means(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n_chars"))
    return rounded(audit.phase_means(turns, ["conv_id"], ["n_chars", "turn"]), "n_chars", "turn")


@query("B4_phase_identity", """SELECT o_orderkey, o_orderstatus <> 'P' AND month(o_orderdate) <> day(o_orderdate) AS phase_unambiguous, CASE WHEN o_orderstatus = 'P' THEN 'unlabeled_excluded' ELSE 'annotated' END AS annotation_role FROM orders""")
def phase_identity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.month("o_orderdate").alias("a"), F.dayofmonth("o_orderdate").alias("b"))
    return audit.phase_identity(orders, "a", "b", F.col("o_orderstatus") == "P").select("o_orderkey", "phase_unambiguous", "annotation_role")


SOURCE_SEGMENTS = ("BUILDING", "AUTOMOBILE")


def manifest(spark, sf_dir):
    """Customers with a role: two segments are the source, one is evaluated, one is excluded, one fits no rule."""
    units = segments(spark, sf_dir)
    split = resample.quota_split(units, "stratum", "unit_id", segment_quotas(units), resample.stratum_seed(2026, "stratum"))
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("unit_id"), F.col("c_mktsegment").alias("stratum"), F.col("c_nationkey").alias("nation")
    )
    evaluation = F.col("stratum") == "MACHINERY"
    return audit.assign_roles(
        customer, "unit_id", F.col("stratum").isin(*SOURCE_SEGMENTS), split.select("unit_id", F.col("role").alias("split")),
        {"ID_EVAL": evaluation & (F.col("nation") < 12), "OOD_EVAL": evaluation & (F.col("nation") >= 12)},
        F.col("stratum") == "FURNITURE", "unlabeled",
    )


SQL_MANIFEST = f"""
{SQL_SEGMENTS}, {sql_place("'2026/' || stratum")}, split AS (SELECT stratum, unit_id, {SQL_QUOTA_ROLE} AS split FROM placed),
manifest AS (
  SELECT s.unit_id, s.stratum, c_nationkey AS nation,
    CASE WHEN stratum IN ('BUILDING', 'AUTOMOBILE') THEN 'SOURCE' WHEN stratum = 'MACHINERY' AND c_nationkey < 12 THEN 'ID_EVAL' WHEN stratum = 'MACHINERY' THEN 'OOD_EVAL' END AS role,
    CASE WHEN stratum IN ('BUILDING', 'AUTOMOBILE') THEN split END AS source_split, CASE WHEN stratum = 'FURNITURE' THEN 'unlabeled' END AS exclusion_reason
  FROM split s JOIN customer ON c_custkey::VARCHAR = unit_id
)
"""


@query("B5_assign_roles", f"WITH {SQL_MANIFEST} SELECT *, role IS NOT NULL AS in_population FROM manifest")
def assign_roles(spark, sf_dir):
    return manifest(spark, sf_dir)


@query("B6_union_cohorts", "SELECT c_custkey AS key, c_nationkey AS nation, 'CUSTOMER' AS role FROM customer UNION ALL SELECT s_suppkey, s_nationkey, 'SUPPLIER' FROM supplier")
def union_cohorts(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("nation"))
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"))
    return audit.union_cohorts({"CUSTOMER": customer, "SUPPLIER": supplier, "OTHER": customer}, ["CUSTOMER", "SUPPLIER"])


@query("B7_one_to_one_join", """WITH l AS (SELECT c_custkey AS key, c_mktsegment FROM customer WHERE c_acctbal > 0), r AS (SELECT o_custkey AS key, count(*) AS n_orders FROM orders GROUP BY 1)
SELECT key, coalesce(c_mktsegment, '') AS c_mktsegment, coalesce(n_orders, 0) AS n_orders, CASE WHEN c_mktsegment IS NULL THEN 'right_only' WHEN n_orders IS NULL THEN 'left_only' ELSE 'both' END AS match FROM l FULL JOIN r USING (key)""")
def one_to_one_join(spark, sf_dir):
    left = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), "c_mktsegment")
    right = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("n_orders"))
    joined = audit.one_to_one_join(left, right, "key")
    return joined.select("key", F.coalesce("c_mktsegment", F.lit("")).alias("c_mktsegment"), F.coalesce("n_orders", F.lit(0)).alias("n_orders"), "match")


@query("B7_join_violations", """SELECT 'right_unique_key' AS "check", o_custkey::VARCHAR AS key, count(*)::VARCHAR AS detail FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def join_violations(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return audit.one_to_one_violations(left, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")), "key")


@query("B8_label_summary", f"""WITH {SQL_ELEMENTS}, c AS (SELECT case_id, pred AS label, count(*) AS n FROM elements GROUP BY 1, 2)
SELECT case_id, string_agg(label || '=' || n, ',' ORDER BY label) AS label_counts, string_agg(label, ',' ORDER BY label) AS observed, coalesce(string_agg(label, ',' ORDER BY label) FILTER (label = 3), '') AS unexpected,
  concat_ws(',', CASE WHEN count(*) FILTER (label = 1) = 0 THEN '1' END, CASE WHEN count(*) FILTER (label = 2) = 0 THEN '2' END) AS missing, count(*) FILTER (label IN (1, 2)) = 2 AS has_required FROM c GROUP BY 1""")
def label_summary(spark, sf_dir):
    out = audit.label_summary(elements(spark, sf_dir), ["case_id"], "pred", (0, 1, 2), (1, 2))
    pairs = F.transform(F.map_entries("label_counts"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"].cast("string")))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",")
    return out.select(
        "case_id", F.array_join(pairs, ",").alias("label_counts"), *[text(c).alias(c) for c in ("observed", "unexpected", "missing")], "has_required"
    )


@query("B9_geometry_comparison", """WITH g AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings),
d AS (SELECT vec_id, label = vec_id % 10 AS same_shape, list_max(list_transform(range(1, 33), lambda i: abs(e[i] - e[i + 32]))) AS spacing_max_diff FROM g)
SELECT vec_id, spacing_max_diff <= 0.4::DOUBLE AS spacing_ok, round(spacing_max_diff, 6) AS spacing_max_diff, same_shape AND spacing_max_diff <= 0.4::DOUBLE AS compatible FROM d""")
def geometry_comparison(spark, sf_dir):
    """The halves of each vector against each other."""
    e = F.col("embedding").cast("array<double>")
    pairs = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice(e, 1, 32).alias("left"), F.slice(e, 33, 32).alias("right"), F.array("label").alias("shape_a"), F.array((F.col("vec_id") % 10).cast("int")).alias("shape_b")
    )
    out = audit.geometry_comparison(pairs, {"spacing": ("left", "right")}, ("shape_a", "shape_b"), 0.4)
    return out.select("vec_id", "spacing_ok", F.round("spacing_max_diff", 6).alias("spacing_max_diff"), "compatible")


SQL_UNITS = "array_to_string(list_transform(embedding[{0}:{1}], lambda v: round(v::DOUBLE * 1e10)::BIGINT::VARCHAR), ',')"


@query("B10_geometry_fingerprint", f"""SELECT vec_id, sha256(concat_ws('|', 'affine=[' || {SQL_UNITS.format(17, 64)} || ']', 'orientation=RAS', 'shape=[' || label || ']', 'spacing=[' || {SQL_UNITS.format(1, 16)} || ']')) AS fingerprint FROM embeddings""")
def geometry_fingerprint(spark, sf_dir):
    e = F.col("embedding").cast("array<double>")
    print_ = audit.geometry_fingerprint({"orientation": F.lit("RAS")}, {"spacing": F.slice(e, 1, 16), "affine": F.slice(e, 17, 48)}, lists={"shape": F.array("label")})
    return table(spark, sf_dir, "embeddings").select("vec_id", print_.alias("fingerprint"))


@query("B11_nested_counts", """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'ALL' ELSE l_returnflag END AS l_returnflag, CASE WHEN grouping(l_linestatus) = 1 THEN 'ALL' ELSE l_linestatus END AS l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""")
def nested_counts(spark, sf_dir):
    return audit.nested_counts(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query("B12_position_ranges", "SELECT (i - 1)::INT AS pos, min(embedding[i]) AS lo, max(embedding[i]) AS hi FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY i")
def position_ranges(spark, sf_dir):
    return audit.position_ranges(table(spark, sf_dir, "embeddings"), "embedding")


@query("B13_spacing_summary", """WITH p AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_tax + 1 AS z FROM lineitem), q AS (SELECT *, (x + y) / 2 AS in_plane, z / ((x + y) / 2) AS ratio FROM p)
SELECT count(*) AS n_cases, round(min(in_plane), 6) AS min_in_plane, round(max(in_plane), 6) AS max_in_plane, round(min(z), 6) AS min_z, round(max(z), 6) AS max_z, round(min(ratio), 6) AS min_ratio, round(max(ratio), 6) AS max_ratio,
  round(median(x), 6) AS median_x, round(median(y), 6) AS median_y, round(median(z), 6) AS median_z, round(median(in_plane), 6) AS median_in_plane, round(median(ratio), 6) AS median_ratio FROM q""")
def spacing_summary(spark, sf_dir):
    spacing = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_tax") + 1).alias("spacing"))
    out = audit.spacing_summary(spacing, "spacing")
    return rounded(out, *[c for c in out.columns if c != "n_cases"])


@query("B14_distinct_elements", "SELECT DISTINCT unnest(string_split(text, ' ')) AS element FROM documents")
def distinct_elements(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.split("text", " ").alias("words"))
    return audit.distinct_elements(words, "words")


@query("B15_set_mismatch", """WITH g AS (SELECT o_custkey, list_sort(list_distinct([o_orderkey % 3, o_custkey % 3])) AS a, list_sort(list_distinct([o_custkey % 3, o_orderkey % 2])) AS b, o_orderkey FROM orders) SELECT o_orderkey FROM g WHERE a <> b""")
def set_mismatch(spark, sf_dir):
    sets = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.array(F.col("o_orderkey") % 3, F.col("o_custkey") % 3).alias("expected"), F.array(F.col("o_custkey") % 3, F.col("o_orderkey") % 2).alias("observed"),
    )
    return audit.set_mismatch(sets, "expected", "observed").select("o_orderkey")


@query("B16_readiness", """SELECT CASE WHEN count(*) FILTER (c_acctbal < -2000) > 0 THEN 'BLOCKED' WHEN TRUE THEN 'REVIEW_REQUIRED' END AS decision, '' AS blocked_reasons,
concat_ws(',', CASE WHEN count(*) FILTER (c_mktsegment = 'BUILDING') <> 75 THEN 'building_count' END, CASE WHEN count(DISTINCT c_mktsegment) <> 5 THEN 'segment_set' END, CASE WHEN count(*) FILTER (c_acctbal < 0) > 0 THEN 'negative_balance' END) AS review_reasons FROM customer""")
def readiness(spark, sf_dir):
    return audit.readiness(
        table(spark, sf_dir, "customer"),
        {"balance_missing": F.count_if(F.col("c_acctbal") < -2000) > 0},
        {
            "building_count": F.count_if(F.col("c_mktsegment") == "BUILDING") != 75,
            "segment_set": F.count_distinct("c_mktsegment") != 5,
            "negative_balance": F.count_if(F.col("c_acctbal") < 0) > 0,
        },
    )


@query("B17_split_overlaps", """WITH s AS (SELECT DISTINCT l_partkey, l_returnflag FROM lineitem) SELECT a.l_returnflag AS split_a, b.l_returnflag AS split_b, count(*) AS n_shared FROM s a JOIN s b ON a.l_partkey = b.l_partkey AND a.l_returnflag < b.l_returnflag GROUP BY 1, 2""")
def split_overlaps(spark, sf_dir):
    return audit.split_overlaps(table(spark, sf_dir, "lineitem"), "l_partkey", "l_returnflag")


@query("B17_overlap_matrix", f"WITH {SQL_MANIFEST}, s(a) AS (VALUES ('CALIBRATION'), ('ID_EVAL'), ('QC_TRAIN'), ('SEG_DEV')) SELECT x.a AS split_a, y.a AS split_b, (SELECT count(*) FROM manifest WHERE source_split = x.a AND source_split = y.a) AS n_shared FROM s x JOIN s y ON x.a < y.a")
def overlap_matrix(spark, sf_dir):
    source = manifest(spark, sf_dir).where("source_split is not null")
    return audit.overlap_matrix(source, "unit_id", "source_split", ["SEG_DEV", "QC_TRAIN", "CALIBRATION", "ID_EVAL"])


@query("B18_visibility", f"WITH {SQL_MANIFEST} SELECT role, count(*) AS n_visible FROM manifest WHERE role IN ('ID_EVAL', 'OOD_EVAL') AND unit_id IN (SELECT o_custkey::VARCHAR FROM orders) GROUP BY 1")
def visibility(spark, sf_dir):
    exported = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("unit_id"))
    return audit.visibility(exported, manifest(spark, sf_dir), "unit_id", "role", ["ID_EVAL", "OOD_EVAL"])


@query("B19_key_reconcile", "SELECT o_orderkey AS key, 'missing' AS status FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT DISTINCT l_orderkey, 'unexpected' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)")
def key_reconcile(spark, sf_dir):
    expected = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return audit.key_reconcile(expected, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), ["key"])


@query("B20_set_hashes", f"WITH {SQL_SCORED} SELECT role, count(unit_id) AS n, {sql_set_digest('unit_id')} AS digest FROM scored GROUP BY 1")
def set_hashes(spark, sf_dir):
    return audit.set_hashes(scored(spark, sf_dir), ["role"], "unit_id")


SQL_ORDER_ROW = "sha256(concat_ws('|', " + ", ".join(
    f"length({c}) || ':' || {c}" for c in ("o_orderkey::VARCHAR", "o_custkey::VARCHAR", "o_orderstatus", "o_orderpriority")
) + "))"


@query("B21_content_hash", f"WITH r AS (SELECT {SQL_ORDER_ROW} AS row FROM orders) SELECT count(*) AS n_rows, {sql_set_digest('row')} AS digest FROM r")
def content_hash(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    return audit.content_hash(orders, volatile=["o_orderdate"])


@query("B22_same_table", "SELECT TRUE AS same_schema, (SELECT count(*) FROM lineitem WHERE l_tax = 0) AS n_missing, 0::BIGINT AS n_extra, FALSE AS identical")
def same_table(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return audit.same_table(lines, lines.where("l_tax <> 0"))


@query("B23_snapshot_changes", """WITH b AS (SELECT doc_id, n_chars FROM documents WHERE doc_id % 7 <> 0), a AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, CASE WHEN b.n_chars IS NULL THEN 'added' WHEN a.n_chars IS NULL THEN 'removed' ELSE 'changed' END AS status FROM b FULL JOIN a USING (doc_id) WHERE b.n_chars IS DISTINCT FROM a.n_chars""")
def snapshot_changes(spark, sf_dir):
    """Two derived inventories of all documents: some removed, some added, some with another size."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    before = docs.where("doc_id % 7 <> 0")
    after = docs.where("doc_id % 3 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return audit.snapshot_changes(before, after, "doc_id", ["n_chars"])


@query("B24_fold_manifest", f"""WITH {SQL_SCORED}, {sql_folds('scored', (2026,))} SELECT k::INT AS fold, CASE WHEN fold = k THEN 'val' ELSE 'train' END AS part, count(*) AS n, {sql_set_digest('unit_id')} AS digest
FROM folds, (SELECT unnest(range(0, 5)) AS k) GROUP BY 1, 2""")
def fold_manifest(spark, sf_dir):
    """Counts and key digests of every part; the long key lists themselves are the operator's output."""
    units = resample.repeated_folds(scored(spark, sf_dir).select("domain", "unit_id"), ["domain"], "unit_id", [2026])
    keys = audit.fold_manifest(units.withColumn("own", F.element_at("folds", 1)), "unit_id", "own", 5)
    return audit.set_hashes(keys, ["fold", "part"], "unit_id")


@query("B25_eligibility", """SELECT doc_id, lang = 'en' AS language, n_chars >= 200 AS long_enough, source <> 'src0' AS known_source, lang = 'en' AND n_chars >= 200 AND source <> 'src0' AS eligible,
  coalesce(CASE WHEN lang <> 'en' THEN 'language' WHEN n_chars < 200 THEN 'long_enough' WHEN source = 'src0' THEN 'known_source' END, '') AS first_failure FROM documents""")
def eligibility(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", "source")
    out = audit.eligibility(docs, {"language": F.col("lang") == "en", "long_enough": F.col("n_chars") >= 200, "known_source": F.col("source") != "src0"})
    return out.select("doc_id", "language", "long_enough", "known_source", "eligible", F.coalesce("first_failure", F.lit("")).alias("first_failure"))


@query("B26_ordered_by_category", """SELECT c_custkey, c_mktsegment, c_nationkey, row_number() OVER (ORDER BY CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 ELSE 3 END, c_nationkey, c_custkey) AS place FROM customer""")
def ordered_by_category(spark, sf_dir):
    """The sort is global and by range; the place shown comes from the numbered partitions of the sorted table."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    ordered = audit.ordered_by_category(customer, "c_mktsegment", ["MACHINERY", "BUILDING", "AUTOMOBILE"], ["c_nationkey", "c_custkey"])
    return audit.numbered(ordered, "place")


@query("B27_probability_quality", f"""WITH {SQL_ELEMENTS} SELECT CASE WHEN case_id % 2 = 0 THEN 'EVEN' ELSE 'ODD' END AS role, count(DISTINCT case_id) AS n_cases, count(*) AS n_elements, round(min(least(p0, p1, p2, p3)), 6) AS p_min,
  round(max(conf), 6) AS p_max, round(max(abs(p0 + p1 + p2 + p3 - 1)), 6) AS sum_error, string_agg(DISTINCT pred::VARCHAR, ',' ORDER BY pred::VARCHAR) AS labels FROM elements GROUP BY 1""")
def probability_quality(spark, sf_dir):
    grid = elements(spark, sf_dir).withColumn("role", F.when(F.col("case_id") % 2 == 0, F.lit("EVEN")).otherwise(F.lit("ODD")))
    return rounded(audit.probability_quality(grid, "p", "pred", "role", "case_id"), "p_min", "p_max", "sum_error")


@query("B28_remap_labels", "SELECT l_linenumber, coalesce(CASE l_linenumber WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 0 END, -1)::INT AS label, count(*) AS n FROM lineitem GROUP BY 1, 2")
def remap_labels(spark, sf_dir):
    label = audit.remap_labels(F.col("l_linenumber"), {1: 3, 2: 2, 3: 1, 4: 0})
    return table(spark, sf_dir, "lineitem").select("l_linenumber", F.coalesce(label, F.lit(-1)).alias("label")).groupBy("l_linenumber", "label").agg(F.count(F.lit(1)).alias("n"))


@query("B29_normalized_label", """WITH v AS (SELECT event_id, value, CASE event_id % 3 WHEN 0 THEN round_even(value, 0) + 0.000005::DOUBLE WHEN 1 THEN round_even(value, 0) ELSE value END AS raw FROM events)
SELECT event_id, CASE WHEN abs(raw - round_even(raw, 0)) <= 0.00001::DOUBLE THEN round_even(raw, 0)::BIGINT ELSE -1 END AS label FROM v""")
def normalize_labels(spark, sf_dir):
    rest = F.col("event_id") % 3
    raw = F.when(rest == 0, F.rint("value") + 0.000005).when(rest == 1, F.rint("value")).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(normalized_label(raw), F.lit(-1)).alias("label"))


@query("B30_linear_rescale", f"""WITH {SQL_ELEMENTS} SELECT e.case_id, x, y, z, CASE WHEN label <> 0 THEN round(intensity * label + -1024::DOUBLE, 6) ELSE -9999 END AS rescaled FROM elements e JOIN embeddings ON vec_id = case_id""")
def linear_rescale(spark, sf_dir):
    params = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), F.col("label").cast("double").alias("slope"), F.lit(-1024.0).alias("intercept"))
    out = audit.linear_rescale(elements(spark, sf_dir), params, "case_id", "intensity")
    return out.select("case_id", "x", "y", "z", F.coalesce(F.round("rescaled", 6), F.lit(-9999.0)).alias("rescaled"))


@query("B31_frame_availability", """WITH f AS (SELECT l_orderkey, l_linenumber AS frame, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1, 2),
h AS (SELECT o_orderkey, (o_custkey % 8)::INT AS ed, (o_orderkey % 8)::INT AS es, 6 AS n_frames FROM orders)
SELECT h.o_orderkey, ed < 6 AND coalesce(a.n, 0) > 0 AS ed_available, es < 6 AND coalesce(b.n, 0) > 0 AS es_available FROM h LEFT JOIN f a ON a.l_orderkey = o_orderkey AND a.frame = ed LEFT JOIN f b ON b.l_orderkey = o_orderkey AND b.frame = es""")
def frame_availability(spark, sf_dir):
    headers = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 8).cast("int").alias("ed"), (F.col("o_orderkey") % 8).cast("int").alias("es"), F.lit(6).alias("n_frames"))
    frames = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("frame")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("n_labelled")
    )
    out = audit.frame_availability(headers, frames, "o_orderkey", {"ed": "ed", "es": "es"}, "n_frames")
    return out.select("o_orderkey", "ed_available", "es_available")


@query("B32_export_cohort", f"WITH {SQL_MANIFEST} SELECT unit_id, role, c_name FROM manifest JOIN customer ON c_custkey::VARCHAR = unit_id WHERE role = 'SOURCE' AND c_acctbal > 0")
def export_cohort(spark, sf_dir):
    audited = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("unit_id"), "c_name", "c_acctbal")
    out = audit.export_cohort(manifest(spark, sf_dir), audited, "unit_id", ["SOURCE"], F.col("c_acctbal") > 0)
    return out.select("unit_id", "role", "c_name")


@query("B33_label_map", """SELECT 'label_map' AS "check", name AS key, detail FROM (SELECT n_name AS name, CASE n_name WHEN 'NATION_1' THEN 'different label' ELSE 'unexpected' END AS detail FROM nation WHERE n_name NOT IN ('NATION_0', 'NATION_2') UNION ALL SELECT 'NOWHERE', 'absent')""")
def label_map(spark, sf_dir):
    observed = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("label"))
    return audit.label_map_violations(observed, {"NATION_0": 0, "NATION_1": 7, "NATION_2": 2, "NOWHERE": 3})


@query("B34_split_report", f"""WITH {SQL_MANIFEST}, m AS (SELECT unit_id, source_split, stratum FROM manifest WHERE source_split IS NOT NULL),
r AS (SELECT sha256(concat_ws('|', length(unit_id) || ':' || unit_id, length(source_split) || ':' || source_split, length(stratum) || ':' || stratum)) AS row FROM m)
SELECT count(*) AS n_rows, count(DISTINCT source_split) AS n_splits, count(DISTINCT stratum) AS n_groups, {sql_set_digest('unit_id')} AS id_digest, 0::BIGINT AS n_overlaps, (SELECT {sql_set_digest('row')} FROM r) AS content_digest FROM m""")
def split_report(spark, sf_dir):
    source = manifest(spark, sf_dir).where("source_split is not null").select("unit_id", "source_split", "stratum")
    return audit.split_report(source, "unit_id", "source_split", "stratum").drop("report")


# --- C: provenance ----------------------------------------------------------------------------------

SQL_C1 = """members AS (SELECT case_id, max(x) AS mx, max(y) AS my, count(*) AS n FROM elements GROUP BY 1)"""
SQL_MEMBER = "concat_ws(',', x::VARCHAR, y::VARCHAR, z::VARCHAR, pred::VARCHAR || '.0')"


@query("C1_array_fingerprint", f"""WITH {SQL_ELEMENTS}, f AS (SELECT case_id, (max(x) + 1) || 'x' || (max(y) + 1) || 'x' || (max(z) + 1) AS shape, {sql_set_digest(SQL_MEMBER)} AS members FROM labelled GROUP BY 1)
SELECT case_id, shape, sha256(concat_ws('|', shape, members)) AS fingerprint FROM f""")
def array_fingerprint(spark, sf_dir):
    from driftgauge.operators.elements import with_argmax
    from driftgauge.plans.bindings import probabilities

    return provenance.array_fingerprints(with_argmax(probabilities(spark, sf_dir), "p"), "case_id", ["x", "y", "z"], "label")


SQL_RECORDS = """
left_side AS (SELECT doc_id::VARCHAR AS id, sha256(lower(text)) AS canonical, sha256(text) AS raw FROM documents),
changed AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN text || ' revised' WHEN doc_id % 3 = 0 THEN lower(text) ELSE text END AS text FROM documents),
right_side AS (SELECT doc_id::VARCHAR AS id, sha256(lower(text)) AS canonical, sha256(text) AS raw FROM changed),
l AS (SELECT canonical, count(*) AS n FROM left_side GROUP BY 1), r AS (SELECT canonical, count(*) AS n, min(id) AS id, min(raw) AS raw FROM right_side GROUP BY 1),
matches AS (
  SELECT s.id, CASE WHEN r.n IS NULL THEN 'NO_MATCH' WHEN r.n > 1 OR l.n > 1 THEN 'AMBIGUOUS' WHEN r.raw = s.raw THEN 'EXACT' ELSE 'EQUIVALENT' END AS status, r.id AS rid
  FROM left_side s JOIN l USING (canonical) LEFT JOIN r USING (canonical)
)
"""


def records(spark, sf_dir):
    """All documents against a copy of them in which some have another case and some another ending."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" revised"))).when(F.col("doc_id") % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    keyed = lambda df: df.select(
        F.col("doc_id").cast("string").alias("id"), F.sha2(F.lower("text"), 256).alias("canonical"), F.sha2("text", 256).alias("raw")
    )
    return keyed(docs), keyed(docs.select("doc_id", changed.alias("text")))


@query("C2_one_to_one_matches", f"WITH {SQL_RECORDS} SELECT id, status, CASE WHEN status IN ('EXACT', 'EQUIVALENT') THEN rid ELSE '' END AS matched_id FROM matches")
def one_to_one_matches(spark, sf_dir):
    """Documents matched by the hash of the whole text in one case."""
    left, right = records(spark, sf_dir)
    out = provenance.one_to_one_matches(left, right, "id", "canonical", "raw")
    return out.withColumn("matched_id", F.coalesce("matched_id", F.lit("")))


@query("C3_units_with_several_cases", """WITH c AS (SELECT DISTINCT o_orderpriority AS scope, o_custkey AS unit, o_orderkey AS case_id FROM orders), s AS (SELECT scope, unit, count(*) AS n_cases FROM c GROUP BY 1, 2 HAVING count(*) > 1) SELECT * FROM c JOIN s USING (scope, unit)""")
def units_with_several_cases(spark, sf_dir):
    cases = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_custkey").alias("unit"), F.col("o_orderkey").alias("case_id"))
    return provenance.units_with_several_cases(cases, "scope", "unit", "case_id")


@query("C4_cross_scope_units", """WITH g AS (SELECT DISTINCT CASE WHEN doc_id % 10 = 0 THEN ' ' ELSE sha256(text) END AS global_id, source FROM documents) SELECT global_id, count(*) AS n_scopes, string_agg(source, ',' ORDER BY source) AS scopes FROM g WHERE trim(global_id) <> '' GROUP BY 1 HAVING count(*) > 1""")
def cross_scope_units(spark, sf_dir):
    blank = F.when(F.col("doc_id") % 10 == 0, F.lit(" ")).otherwise(F.sha2("text", 256))
    docs = table(spark, sf_dir, "documents").select(blank.alias("global_id"), "source")
    return provenance.cross_scope_units(docs, "source", "global_id")


@query("C5_duplicate_groups", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_groups(spark, sf_dir):
    return provenance.duplicate_groups(table(spark, sf_dir, "documents"), "text", "doc_id")


@query("C6_authoritative_matches", f"WITH {SQL_RECORDS} SELECT id, status, rid AS matched_id FROM matches WHERE status IN ('EXACT', 'EQUIVALENT')")
def authoritative_matches(spark, sf_dir):
    left, right = records(spark, sf_dir)
    return provenance.authoritative(provenance.one_to_one_matches(left, right, "id", "canonical", "raw"))
