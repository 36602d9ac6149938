"""Queries of the source, sink and contract family (A)."""
from __future__ import annotations

from pyspark.sql import functions as F

from driftgauge.operators import contracts
from driftgauge.plans.bindings import SQL_SCORED, scored, sql_set_digest, table
from driftgauge.plans.registry import query
from driftgauge.session import compute_tasks, cut_lineage, scratch_path
from driftgauge.sources import files, sinks, tables

# --- readers and writers ---------------------------------------------------------------------


@query("A1_parquet_allow_list", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def parquet_allow_list(spark, sf_dir):
    return tables.scan_allowed(spark, f"{sf_dir}/customer.parquet", ["c_custkey", "c_name", "c_mktsegment"])


def customer_csv(spark, sf_dir):
    path = scratch_path(spark, "customer-csv")
    table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal").write.option("header", True).csv(path)
    return tables.scan_csv(
        spark, path, ["c_custkey", "c_name", "c_nationkey", "c_acctbal"],
        rename={"c_custkey": "unit_id"}, integers=["c_nationkey", "c_acctbal"],
    )


@query("A2_csv_scan", """SELECT c_custkey::VARCHAR AS unit_id, c_name, c_nationkey::BIGINT AS c_nationkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN c_acctbal::BIGINT ELSE -1 END AS whole_acctbal FROM customer""")
def csv_scan(spark, sf_dir):
    typed, _ = customer_csv(spark, sf_dir)
    return typed.select("unit_id", "c_name", "c_nationkey", F.coalesce("c_acctbal", F.lit(-1)).alias("whole_acctbal"))


@query("A2_csv_violations", """SELECT "check", key, count(*) AS n, round(sum(detail::DOUBLE), 2) AS total FROM (SELECT 'integer' AS "check", 'c_acctbal' AS key, c_acctbal AS detail FROM customer WHERE c_acctbal <> floor(c_acctbal)) GROUP BY 1, 2""")
def csv_violations(spark, sf_dir):
    _, problems = customer_csv(spark, sf_dir)
    return problems.groupBy("check", "key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("detail").cast("double")), 2).alias("total"))


SQL_LEDGER = f"""
metric AS (SELECT grp, role, count(*)::DOUBLE AS n, avg(abs(q_hat - q_true)) AS mae FROM scored GROUP BY 1, 2),
ledger AS (
  SELECT grp || '-' || role || '-' || quantity AS result_id, grp AS dataset, role AS endpoint, quantity, round(v, 6) AS full_precision,
    CASE WHEN quantity = 'n' THEN v::BIGINT::VARCHAR WHEN grp = 'ASIA' THEN '' ELSE 'about ' || floor(v * 100)::BIGINT::VARCHAR END AS display, 'FINAL' AS status
  FROM (SELECT grp, role, n, mae FROM metric) UNPIVOT (v FOR quantity IN (n, mae))
)
"""


def ledger_rows(spark, sf_dir):
    """A ledger with one row per region, role and quantity; one region lacks some display texts."""
    metric = scored(spark, sf_dir).groupBy("grp", "role").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.abs(F.col("q_hat") - F.col("q_true"))).alias("mae")
    )
    long = metric.select("grp", "role", F.explode(F.create_map(F.lit("n"), F.col("n"), F.lit("mae"), F.col("mae"))).alias("quantity", "v"))
    display = (
        F.when(F.col("quantity") == "n", F.col("v").cast("bigint").cast("string"))
        .when(F.col("grp") == "ASIA", F.lit(""))
        .otherwise(F.concat(F.lit("about "), F.floor(F.col("v") * 100).cast("string")))
    )
    return long.select(
        F.concat_ws("-", "grp", "role", "quantity").alias("result_id"), F.col("grp").alias("dataset"), F.col("role").alias("endpoint"),
        "quantity", F.round("v", 6).alias("full_precision"), display.alias("display"), F.lit("FINAL").alias("status"),
    )


def ledger(spark, sf_dir):
    path = scratch_path(spark, "ledger-json")
    ledger_rows(spark, sf_dir).write.json(path)
    return tables.scan_ledger(spark, path)


@query("A3_json_ledger", f"WITH {SQL_SCORED}, {SQL_LEDGER} SELECT * FROM ledger")
def json_ledger(spark, sf_dir):
    return ledger(spark, sf_dir)


@query("A3_ledger_contract", f"""WITH {SQL_SCORED}, {SQL_LEDGER} SELECT 'content' AS "check", result_id AS key, 'display' AS detail FROM ledger WHERE display = ''""")
def ledger_contract(spark, sf_dir):
    return tables.ledger_contract(ledger(spark, sf_dir))


def customer_tree(spark, sf_dir):
    """Folders by nation and kind: every customer is an image, those in debt have a truth."""
    root = scratch_path(spark, "customer-tree")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.concat(F.lit("N"), F.col("c_nationkey")).alias("entity"))
    both = customer.withColumn("kind", F.lit("image")).unionByName(
        customer.where("c_acctbal < -900").withColumn("kind", F.lit("truth"))
    )
    both.repartition("entity", "kind").write.partitionBy("entity", "kind").parquet(root)
    return root


KINDS = {"image": "kind=image/", "truth": "kind=truth/"}


@query("A4_directory_entities", """SELECT 'N' || c_nationkey AS entity, 1 + (min(c_acctbal) < -900)::INT::BIGINT AS n_files, TRUE AS has_image, min(c_acctbal) < -900 AS has_truth, FALSE AS repeated_image, FALSE AS repeated_truth
FROM customer GROUP BY c_nationkey""")
def directory_entities(spark, sf_dir):
    inventory = files.inventory(spark, customer_tree(spark, sf_dir), "*.parquet")
    return files.entities(inventory, "^entity=([^/]+)/", KINDS)


@query("A5_file_digests")
def file_digests(spark, sf_dir):
    return files.digests(spark, sf_dir, "*.parquet")


@query("A5_digest_reconcile")
def digest_reconcile(spark, sf_dir):
    """Expected: all files but the orders, and another digest for the lines."""
    # pinned, as both sides come from it: each file is read once
    seen = cut_lineage(files.digests(spark, sf_dir, "*.parquet", "md5"))
    expected = seen.where("path <> 'orders.parquet'").withColumn(
        "digest", F.when(F.col("path") == "lineitem.parquet", F.lit("0" * 32)).otherwise(F.col("digest"))
    )
    return files.reconcile(seen, expected)


@query("A5b_tree_digest")
def tree_digest(spark, sf_dir):
    return files.tree_digest(files.digests(spark, sf_dir, "*.parquet"))


# Files whose bytes SQL knows: one text file a supplier, in a folder of its key.
SQL_WRITTEN = "written AS (SELECT s_suppkey AS key, s_name || ' in nation ' || s_nationkey || chr(10) AS content FROM supplier)"


def written_files(spark, sf_dir):
    """``(path, length, digest)`` of the files, with the key's folder as the path."""
    root = scratch_path(spark, "supplier-files")
    line = F.concat("s_name", F.lit(" in nation "), F.col("s_nationkey").cast("string")).alias("line")
    tasks = compute_tasks(spark)
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), line).repartition(tasks, "key")
    rows.write.partitionBy("key").text(root)
    return files.digests(spark, root, "*.txt", tasks=tasks).withColumn("path", F.regexp_extract("path", "key=([0-9]+)/", 1))


@query("A5_written_digests", f"WITH {SQL_WRITTEN} SELECT key::VARCHAR AS path, length(content)::BIGINT AS length, sha256(content) AS digest FROM written")
def written_digests(spark, sf_dir):
    return written_files(spark, sf_dir)


@query("A5_written_reconcile", f"""WITH {SQL_WRITTEN} SELECT key::VARCHAR AS path, CASE WHEN key % 7 = 0 THEN 'unexpected' WHEN key % 7 = 1 THEN 'size' ELSE 'digest' END AS status FROM written WHERE key % 7 < 3
UNION ALL SELECT 'nowhere', 'missing'""")
def written_reconcile(spark, sf_dir):
    # pinned, as both sides come from it: each file is read once
    seen = cut_lineage(written_files(spark, sf_dir))
    key = F.col("path").cast("bigint") % 7
    expected = seen.where(key > 0).select(
        "path", F.when(key == 1, F.col("length") + 1).otherwise(F.col("length")).alias("length"), F.when(key == 2, F.lit("0" * 64)).otherwise(F.col("digest")).alias("digest")
    )
    absent = spark.createDataFrame([("nowhere", 1, "0")], "path string, length bigint, digest string")
    return files.reconcile(seen, expected.unionByName(absent))


@query("A5b_written_tree", f"WITH {SQL_WRITTEN}, pairs AS (SELECT concat_ws(' ', key::VARCHAR, sha256(content)) AS pair FROM written) SELECT count(*) AS n_files, {sql_set_digest('pair')} AS digest FROM pairs")
def written_tree(spark, sf_dir):
    return files.tree_digest(written_files(spark, sf_dir))


@query("A6_parquet_sink", "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders")
def parquet_sink(spark, sf_dir):
    path = scratch_path(spark, "orders-parquet")
    sinks.write_parquet(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), path, ["o_custkey", "o_orderkey"])
    return spark.read.parquet(path).withColumn("o_totalprice", F.round("o_totalprice", 2))


@query("A7_csv_sink", """SELECT o_orderkey::VARCHAR AS o_orderkey, '["' || o_orderstatus || '","' || o_orderpriority || '"]' AS tags FROM orders""")
def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "orders-csv")
    sinks.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", F.array("o_orderstatus", "o_orderpriority").alias("tags")), path)
    return spark.read.option("header", True).option("escape", '"').csv(path)


SQL_SEGMENT_ROW = """sha256(concat_ws('|', length(c_custkey::VARCHAR) || ':' || c_custkey::VARCHAR, length(c_mktsegment) || ':' || c_mktsegment))"""


@query("A8_json_twin", f"""WITH r AS (SELECT c_mktsegment, {SQL_SEGMENT_ROW} AS row FROM customer), c AS (SELECT c_mktsegment AS k, count(*) AS n FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM r) AS n_rows, (SELECT '[' || string_agg('{{"k":"' || k || '","n":' || n || '}}', ',' ORDER BY k) || ']' FROM c) AS counts, (SELECT {sql_set_digest('row')} FROM r) AS content_digest""")
def json_twin(spark, sf_dir):
    path = scratch_path(spark, "customer-twin")
    sinks.write_json_twin(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), path, "c_mktsegment")
    return spark.read.schema("n_rows bigint, counts string, content_digest string").json(f"{path}/summary")


@query("A9_write_once", "SELECT 1 AS step, 'written' AS outcome, count(*) AS n_rows FROM customer UNION ALL SELECT 2, 'identical', count(*) FROM customer UNION ALL SELECT 3, 'refused', count(*) FROM customer UNION ALL SELECT 4, 'refused', count(*) FROM customer")
def write_once(spark, sf_dir):
    """First write, a verified repeat, an unverified repeat and a repeat with other content."""
    path = scratch_path(spark, "customer-once")
    customer = table(spark, sf_dir, "customer")

    def attempt(df, verify):
        try:
            return sinks.write_once(df, path, verify=verify)
        except contracts.ContractError:
            return "refused"

    outcomes = [attempt(customer, False), attempt(customer, True), attempt(customer, False), attempt(customer.where("c_acctbal > 0"), True)]
    steps = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(o).alias("outcome")) for i, o in enumerate(outcomes)]))
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select("n_rows", steps.alias("s")).select("s.*", "n_rows")


# --- contracts ----------------------------------------------------------------------------------


@query("A10_contract_report", """SELECT 'schema' AS "check", 'o_comment' AS key, 'missing' AS detail UNION ALL SELECT 'schema', 'o_orderdate', 'unexpected' UNION ALL SELECT 'leakage', 'o_totalprice', 'forbidden name'
UNION ALL SELECT 'range', 'o_totalprice', count(*)::VARCHAR FROM orders WHERE o_totalprice > 1 OR o_totalprice < 0
UNION ALL SELECT 'unique_key', o_custkey::VARCHAR, count(*)::VARCHAR FROM orders GROUP BY o_custkey HAVING count(*) > 1""")
def contract_report(spark, sf_dir):
    """Schema, leakage, key and value checks of one table in one violations table."""
    orders = table(spark, sf_dir, "orders")
    return contracts.contract_violations(
        orders, keys=["o_custkey"], finite=["o_totalprice"], unit_interval=["o_totalprice"],
        ordered_columns=["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_comment", "o_orderpriority"],
        forbidden=["O_TOTALPRICE", "dice"],
    )


@query("A11_leakage", f"""WITH {SQL_SCORED} SELECT 'leakage' AS "check", c AS key, CASE WHEN c = 'q_hat' THEN 'forbidden name' ELSE 'forbidden token' END AS detail, n AS n_rows FROM (SELECT unnest(['q_true', 'q_hat']) AS c), (SELECT count(*) AS n FROM scored)""")
def leakage(spark, sf_dir):
    units = scored(spark, sf_dir)
    found = contracts.leakage_violations(units, ["Q_HAT"], ["true", "dice"])
    return found.join(F.broadcast(units.agg(F.count(F.lit(1)).alias("n_rows"))))


SQL_SPOILED = """lines AS (SELECT l_quantity, l_discount, l_tax, CASE l_linenumber WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN 'inf'::DOUBLE WHEN 3 THEN NULL ELSE l_extendedprice / 60000 END AS price FROM lineitem)"""


def spoiled(spark, sf_dir):
    price = (
        F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).when(F.col("l_linenumber") == 2, F.lit(float("inf")))
        .when(F.col("l_linenumber") == 3, F.lit(None)).otherwise(F.col("l_extendedprice") / 60000)
    )
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_discount", "l_tax", price.cast("double").alias("price"))


SQL_BAD = "({c} IS NULL OR isnan({c}) OR isinf({c}))"
SQL_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({SQL_BAD.format(c=c)}) AS not_finite, count(*) FILTER (NOT {SQL_BAD.format(c=c)} AND ({c} < 0 OR {c} > 1)) AS out_of_range FROM lines"
    for c in ("l_quantity", "l_discount", "l_tax", "price")
)


@query("A13_finite_profile", f"WITH {SQL_SPOILED} SELECT column_name, not_finite FROM ({SQL_PROFILE})")
def finite_profile(spark, sf_dir):
    return contracts.value_profile(spoiled(spark, sf_dir), ["l_quantity", "l_discount", "l_tax", "price"]).select("column_name", "not_finite")


@query("A14_range_profile", f"WITH {SQL_SPOILED} {SQL_PROFILE}")
def range_profile(spark, sf_dir):
    columns = ["l_quantity", "l_discount", "l_tax", "price"]
    return contracts.value_profile(spoiled(spark, sf_dir), columns, columns)


@query("A15_key_profile", """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_keys, count(*) FILTER (n > 1) AS n_duplicated, 0::BIGINT AS n_empty FROM k""")
def key_profile(spark, sf_dir):
    return contracts.key_profile(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("A15_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return contracts.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("A16_count_reconcile", """WITH o AS (SELECT c_mktsegment, c_nationkey, count(*) AS observed FROM customer GROUP BY 1, 2), e AS (SELECT c_mktsegment, c_nationkey, count(*) AS expected FROM customer WHERE c_acctbal > 0 GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, coalesce(observed, 0) AS observed, coalesce(expected, 0) AS expected FROM o FULL JOIN e USING (c_mktsegment, c_nationkey) WHERE coalesce(observed, 0) <> coalesce(expected, 0)""")
def count_reconcile(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    keys = ["c_mktsegment", "c_nationkey"]
    expected = customer.where("c_acctbal > 0").groupBy(*keys).agg(F.count(F.lit(1)).alias("expected"))
    return contracts.count_reconcile(customer, keys, expected)


@query("A17_path_safety", """WITH p AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '/' || url WHEN 1 THEN 'a/../' || page_id WHEN 2 THEN NULL WHEN 3 THEN 'a/b..c/' || page_id ELSE url END AS path FROM pages)
SELECT page_id, path IS NULL OR path = '' OR path LIKE '/%' OR list_contains(string_split(path, '/'), '..') AS unsafe FROM p""")
def path_safety(spark, sf_dir):
    rest = F.col("page_id") % 5
    path = (
        F.when(rest == 0, F.concat(F.lit("/"), F.col("url"))).when(rest == 1, F.concat(F.lit("a/../"), F.col("page_id")))
        .when(rest == 2, F.lit(None)).when(rest == 3, F.concat(F.lit("a/b..c/"), F.col("page_id"))).otherwise(F.col("url"))
    )
    return table(spark, sf_dir, "pages").select("page_id", contracts.unsafe_path(path).alias("unsafe"))


@query("A18_identifier_number", r"""SELECT c_custkey, CASE WHEN regexp_matches(c_name, '^Customer#0*([0-9]+)$') THEN regexp_extract(c_name, '^Customer#0*([0-9]+)$', 1)::BIGINT END AS number FROM customer""")
def identifier_number(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", contracts.identifier_number("c_name", "^Customer#0*([0-9]+)$").alias("number"))


REGION_NAMES = {"0": "AFRICA", "1": "AMERICA", "2": "ASIA", "3": "EURASIA", "9": "ATLANTIS"}


@query("A19_mapping_violations", """WITH seen AS (SELECT n_regionkey::VARCHAR AS code, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT code, count(DISTINCT r_name) AS k, min(r_name) AS name FROM seen GROUP BY 1), e(code, want) AS (VALUES ('0', 'AFRICA'), ('1', 'AMERICA'), ('2', 'ASIA'), ('3', 'EURASIA'), ('9', 'ATLANTIS'))
SELECT 'mapping' AS "check", code AS key, CASE WHEN k IS NULL THEN 'code not seen' WHEN want IS NULL THEN 'unexpected code' WHEN k > 1 THEN 'several names' ELSE 'wrong name' END AS detail
FROM s FULL JOIN e USING (code) WHERE k IS NULL OR want IS NULL OR k > 1 OR name <> want""")
def mapping_violations(spark, sf_dir):
    seen = (
        table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return contracts.mapping_violations(seen, "n_regionkey", "r_name", REGION_NAMES)


@query("A20_population_profile", f"WITH {SQL_SCORED} SELECT count(DISTINCT grp) AS n_populations, min(grp) AS population, count(*) AS n_rows, count(DISTINCT unit_id) AS n_ids FROM scored")
def population_profile(spark, sf_dir):
    return contracts.population_profile(scored(spark, sf_dir), "grp", "unit_id")
