"""How the sample tables are read as units, features, elements and identity records.

The numeric columns of the sample tables are statistically independent, so a
prediction with a known shift is derived from a hash of the key. Each binding has
its SQL twin next to it.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import hash60, hash_uniform
from driftgauge.session import cut_lineage

IN_DOMAIN, OUT_DOMAIN = "ID", "OOD"
SEEDS = tuple(range(2026, 2036))

# SQL macros of the hash functions.
SQL_HASH60 = "('0x' || substr(md5({0}), 1, 15))::BIGINT"
SQL_TWO60 = "1152921504606846976.0::DOUBLE"


def sql_hash(text: str) -> str:
    return SQL_HASH60.format(text)


def sql_uniform(text: str) -> str:
    return f"(({sql_hash(text)})::DOUBLE / {SQL_TWO60})"


def sql_set_digest(value: str) -> str:
    """SQL twin of ``set_digest``."""
    sums = ", ".join(
        f"coalesce(sum(('0x' || substr(sha256({value}), {start}, 15))::HUGEINT), 0)::VARCHAR" for start in (1, 16, 31, 46)
    )
    return f"sha256(concat_ws(':', count({value})::VARCHAR, {sums}))"


def sql_row_digest(columns: list[str]) -> str:
    """SQL twin of ``row_digest`` for text expressions."""
    parts = ", ".join(f"coalesce(length({c})::VARCHAR || ':' || {c}, '-')" for c in columns)
    return f"sha256(concat_ws('|', {parts}))"


def sql_fold(position: str, size: str, k: int) -> str:
    """SQL twin of ``fold_of``."""
    return (
        f"(CASE WHEN {position} < ({size} % {k}) * ({size} // {k} + 1) THEN {position} // ({size} // {k} + 1) "
        f"ELSE ({size} % {k}) + ({position} - ({size} % {k}) * ({size} // {k} + 1)) // greatest({size} // {k}, 1) END)"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored units from orders: group = region, ID = two regions, q_hat shifted out of domain."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("grp"))
    u = hash_uniform("unit_id")
    is_id = F.col("grp").isin("AFRICA", "AMERICA")
    return (
        orders.join(customer, "o_custkey").join(nation, "n_nationkey").join(region, "r_regionkey")
        .select(F.col("o_orderkey").cast("string").alias("unit_id"), "grp", (F.col("o_totalprice") / 500000).alias("q_true"))
        .select(
            "unit_id",
            "grp",
            F.when(is_id, F.lit(IN_DOMAIN)).otherwise(F.lit(OUT_DOMAIN)).alias("domain"),
            "q_true",
            F.when(is_id, 0.25 + 0.5 * F.col("q_true") + 0.2 * (u - 0.5)).otherwise(0.40 + 0.3 * F.col("q_true") + 0.3 * (u - 0.5)).alias("q_hat"),
            role_of("unit_id"),
        )
    )


def scored_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored units from suppliers: few enough for SQL to follow the whole protocol of 10 repeats and 2,000 replicates.

    A hash below one unit of the balance keeps the values off a decimal grid, on which rounded results would tie.
    """
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("grp"))
    u = hash_uniform("unit_id")
    is_id = F.col("grp").isin("AFRICA", "AMERICA")
    units = supplier.join(nation, "n_nationkey").join(region, "r_regionkey").select(F.col("s_suppkey").cast("string").alias("unit_id"), "grp", "s_acctbal")
    return units.select("unit_id", "grp", ((F.col("s_acctbal") + 1000 + hash_uniform(F.lit("cents"), "unit_id")) / 11001).alias("q_true")).select(
        "unit_id", "grp", F.when(is_id, F.lit(IN_DOMAIN)).otherwise(F.lit(OUT_DOMAIN)).alias("domain"), "q_true",
        F.when(is_id, 0.25 + 0.5 * F.col("q_true") + 0.2 * (u - 0.5)).otherwise(0.40 + 0.3 * F.col("q_true") + 0.3 * (u - 0.5)).alias("q_hat"),
    )


def role_of(id_col: str):
    """Half training, a quarter calibration, a quarter evaluation, by hash of the key."""
    bucket = F.pmod(hash60(F.lit("role"), id_col), F.lit(4))
    return F.when(bucket < 2, F.lit("QC_TRAIN")).when(bucket == 2, F.lit("CALIBRATION")).otherwise(F.lit("EVAL")).alias("role")


SQL_ROLE_HASH = sql_hash("concat_ws(':', 'role', unit_id)")
SQL_ROLE = f"CASE {SQL_ROLE_HASH} % 4 WHEN 0 THEN 'QC_TRAIN' WHEN 1 THEN 'QC_TRAIN' WHEN 2 THEN 'CALIBRATION' ELSE 'EVAL' END"

SQL_SCORED = f"""
scored0 AS (
  SELECT o_orderkey::VARCHAR AS unit_id, r_name AS grp, o_totalprice / 500000 AS q_true
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
scored AS (
  SELECT unit_id, grp, CASE WHEN grp IN ('AFRICA', 'AMERICA') THEN 'ID' ELSE 'OOD' END AS domain, q_true,
    CASE WHEN grp IN ('AFRICA', 'AMERICA') THEN 0.25::DOUBLE + 0.5::DOUBLE * q_true + 0.2::DOUBLE * ({sql_uniform('unit_id')} - 0.5::DOUBLE)
         ELSE 0.40::DOUBLE + 0.3::DOUBLE * q_true + 0.3::DOUBLE * ({sql_uniform('unit_id')} - 0.5::DOUBLE) END AS q_hat,
    {SQL_ROLE} AS role
  FROM scored0
)
"""


SQL_SUPPLIERS = f"""
scored0 AS (
  SELECT s_suppkey::VARCHAR AS unit_id, r_name AS grp, (s_acctbal + 1000 + {sql_uniform("concat_ws(':', 'cents', s_suppkey::VARCHAR)")}) / 11001 AS q_true
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
),
scored AS (
  SELECT unit_id, grp, CASE WHEN grp IN ('AFRICA', 'AMERICA') THEN 'ID' ELSE 'OOD' END AS domain, q_true,
    CASE WHEN grp IN ('AFRICA', 'AMERICA') THEN 0.25::DOUBLE + 0.5::DOUBLE * q_true + 0.2::DOUBLE * ({sql_uniform('unit_id')} - 0.5::DOUBLE)
         ELSE 0.40::DOUBLE + 0.3::DOUBLE * q_true + 0.3::DOUBLE * ({sql_uniform('unit_id')} - 0.5::DOUBLE) END AS q_hat
  FROM scored0
)
"""


def sql_folds(source: str, seeds: tuple[int, ...] = SEEDS, k: int = 5, keep: str = "") -> str:
    """CTE ``folds(domain, unit_id, repeat, fold)`` over ``source``."""
    seed_rows = ", ".join(f"({i}, {s})" for i, s in enumerate(seeds))
    return f"""
placed AS (
  SELECT domain, unit_id, repeat, row_number() OVER (PARTITION BY domain, repeat ORDER BY md5(concat_ws(':', seed::VARCHAR, unit_id)), unit_id) - 1 AS pos,
    count(*) OVER (PARTITION BY domain, repeat) AS n
  FROM {source}, (VALUES {seed_rows}) AS s(repeat, seed)
),
folds AS (SELECT domain, unit_id, repeat, {sql_fold('pos', 'n', k)} AS fold FROM placed)
"""


def sql_bootstrap(source: str, resamples: int, seed: int = 2026) -> str:
    """CTE ``boot(domain, replicate, unit_id, m)`` over ``source``; replicate 0 is the sample itself."""
    return f"""
slot AS (
  SELECT domain, unit_id, row_number() OVER (PARTITION BY domain ORDER BY md5(concat_ws(':', '{seed}', unit_id)), unit_id) - 1 AS pos,
    count(*) OVER (PARTITION BY domain) AS n
  FROM {source}
),
hashed AS (
  SELECT domain, n, pair, md5(concat_ws(':', '{seed}', domain, pair::VARCHAR, pos::VARCHAR)) AS h FROM slot, (SELECT unnest(range(1, {(resamples + 1) // 2 + 1})) AS pair)
),
draws AS (
  SELECT domain, replicate, pos, count(*) AS m FROM (
    SELECT domain, 2 * pair - 1 AS replicate, ('0x' || substr(h, 1, 15))::BIGINT % n AS pos FROM hashed
    UNION ALL SELECT domain, 2 * pair, ('0x' || substr(h, 16, 15))::BIGINT % n FROM hashed
  ) WHERE replicate <= {resamples} GROUP BY ALL
),
boot AS (
  SELECT d.domain, d.replicate, s.unit_id, d.m FROM draws d JOIN slot s ON s.domain = d.domain AND s.pos = d.pos
  UNION ALL SELECT domain, 0, unit_id, 1 FROM {source}
)
"""


# 15 ordered features of an order, from its lines.
FEATURES = (
    "n_lines", "qty_mean", "qty_max", "price_mean", "price_max", "discount_mean", "discount_max", "tax_mean", "tax_max",
    "returned_fraction", "open_fraction", "n_parts", "n_suppliers", "qty_sum", "revenue_mean",
)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``unit_id, domain, split, <15 features>, target`` per order that has lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"
    )
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = lines.groupBy(F.col("l_orderkey").cast("string").alias("unit_id")).agg(
        F.count(F.lit(1)).cast("double").alias("n_lines"),
        F.avg("l_quantity").alias("qty_mean"), F.max("l_quantity").alias("qty_max"),
        F.avg("l_extendedprice").alias("price_mean"), F.max("l_extendedprice").alias("price_max"),
        F.avg("l_discount").alias("discount_mean"), F.max("l_discount").alias("discount_max"),
        F.avg("l_tax").alias("tax_mean"), F.max("l_tax").alias("tax_max"),
        F.avg((F.col("l_returnflag") == "R").cast("double")).alias("returned_fraction"),
        F.avg((F.col("l_linestatus") == "O").cast("double")).alias("open_fraction"),
        F.size(F.collect_set("l_partkey")).cast("double").alias("n_parts"),
        F.size(F.collect_set("l_suppkey")).cast("double").alias("n_suppliers"),
        F.sum("l_quantity").alias("qty_sum"), F.avg(revenue).alias("revenue_mean"),
    )
    keyed = scored(spark, sf_dir).select("unit_id", "domain", F.col("role").alias("split"), "q_true", F.col("q_hat").alias("__q"))
    target = 0.5 + 0.004 * (F.col("qty_mean") - 25.0) - 1.5 * (F.col("discount_mean") - 0.05) + 0.2 * (F.col("q_true") - 0.5)
    return per_order.join(keyed, "unit_id").select("unit_id", "domain", "split", *FEATURES, target.alias("target"))


def feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features written once, as a stored artifact would be: fits read them several times."""
    return cut_lineage(features(spark, sf_dir))


SQL_FEATURES = """
lines AS (
  SELECT l_orderkey::VARCHAR AS unit_id, count(*)::DOUBLE AS n_lines, avg(l_quantity) AS qty_mean, max(l_quantity) AS qty_max,
    avg(l_extendedprice) AS price_mean, max(l_extendedprice) AS price_max, avg(l_discount) AS discount_mean, max(l_discount) AS discount_max,
    avg(l_tax) AS tax_mean, max(l_tax) AS tax_max, avg((l_returnflag = 'R')::INT::DOUBLE) AS returned_fraction,
    avg((l_linestatus = 'O')::INT::DOUBLE) AS open_fraction, count(DISTINCT l_partkey)::DOUBLE AS n_parts,
    count(DISTINCT l_suppkey)::DOUBLE AS n_suppliers, sum(l_quantity) AS qty_sum, avg(l_extendedprice * (1 - l_discount)) AS revenue_mean
  FROM lineitem GROUP BY 1
),
features AS (
  SELECT l.*, s.domain, s.role AS split,
    0.5::DOUBLE + 0.004::DOUBLE * (qty_mean - 25) - 1.5::DOUBLE * (discount_mean - 0.05::DOUBLE) + 0.2::DOUBLE * (q_true - 0.5::DOUBLE) AS target
  FROM lines l JOIN scored s USING (unit_id)
)
"""

CLASSES = 4
LABELS = (0, 1, 2, 3)


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``case_id, x, y, z, p``: every embedding read as a 4 x 4 x 4 grid; a cell's 4-class softmax (scaled by 8) is over its own component and those a
    quarter of the vector further on, in a circle."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding")
    logit = lambda k: F.exp(F.col("embedding")[(F.col("cell") + 16 * k) % 64].cast("double") * 8.0)
    cell = vectors.select("case_id", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("cell"), "embedding").select(
        "case_id", "cell", F.array(*map(logit, range(CLASSES))).alias("e")
    )
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    return cell.select(
        "case_id", F.floor(F.col("cell") % 16 / 4).cast("int").alias("x"), (F.col("cell") % 4).cast("int").alias("y"), F.floor(F.col("cell") / 16).cast("int").alias("z"),
        F.transform("e", lambda v: v / total).alias("p"),
    )


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction, reference (the argmax of the next case) and a derived intensity on the same grid."""
    from driftgauge.functions import argmax_index

    p = probabilities(spark, sf_dir).withColumn("pred", argmax_index("p"))
    # the last case is followed by the first
    ends = F.broadcast(table(spark, sf_dir, "embeddings").agg(F.min("vec_id").alias("__least"), F.max("vec_id").alias("__most")))
    before = F.when(F.col("case_id") == F.col("__least"), F.col("__most")).otherwise(F.col("case_id") - 1)
    ref = p.join(ends).select(before.alias("case_id"), "x", "y", "z", F.col("pred").alias("ref"))
    intensity = F.when(F.pmod(hash60("case_id", "x", "y", "z"), F.lit(4)) == 0, F.lit(0.0)).otherwise(hash_uniform("case_id", "z", "y", "x") + 0.5)
    return p.join(ref, ["case_id", "x", "y", "z"]).withColumn("intensity", intensity)


SQL_ELEMENTS = f"""
cells AS (
  SELECT vec_id AS case_id, c AS cell, exp(embedding[c + 1]::DOUBLE * 8) AS e0, exp(embedding[(c + 16) % 64 + 1]::DOUBLE * 8) AS e1,
    exp(embedding[(c + 32) % 64 + 1]::DOUBLE * 8) AS e2, exp(embedding[(c + 48) % 64 + 1]::DOUBLE * 8) AS e3
  FROM embeddings, (SELECT unnest(range(0, 64)) AS c)
),
probs AS (
  SELECT case_id, (cell % 16 // 4)::INT AS x, (cell % 4)::INT AS y, (cell // 16)::INT AS z, e0 / (e0 + e1 + e2 + e3) AS p0, e1 / (e0 + e1 + e2 + e3) AS p1,
    e2 / (e0 + e1 + e2 + e3) AS p2, e3 / (e0 + e1 + e2 + e3) AS p3
  FROM cells
),
labelled AS (
  SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 AND p0 >= p3 THEN 0 WHEN p1 >= p2 AND p1 >= p3 THEN 1 WHEN p2 >= p3 THEN 2 ELSE 3 END AS pred,
    greatest(p0, p1, p2, p3) AS conf,
    -(CASE WHEN p0 > 0 THEN p0 * ln(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * ln(p1) ELSE 0 END
      + CASE WHEN p2 > 0 THEN p2 * ln(p2) ELSE 0 END + CASE WHEN p3 > 0 THEN p3 * ln(p3) ELSE 0 END) AS entropy
  FROM probs
),
elements AS (
  SELECT a.*, b.pred AS ref,
    CASE WHEN {sql_hash("concat_ws(':', a.case_id::VARCHAR, a.x::VARCHAR, a.y::VARCHAR, a.z::VARCHAR)")} % 4 = 0 THEN 0.0
         ELSE {sql_uniform("concat_ws(':', a.case_id::VARCHAR, a.z::VARCHAR, a.y::VARCHAR, a.x::VARCHAR)")} + 0.5 END AS intensity
  FROM labelled a JOIN labelled b ON b.case_id = CASE WHEN a.case_id = (SELECT max(vec_id) FROM embeddings) THEN (SELECT min(vec_id) FROM embeddings) ELSE a.case_id + 1 END
    AND b.x = a.x AND b.y = a.y AND b.z = a.z
)
"""
