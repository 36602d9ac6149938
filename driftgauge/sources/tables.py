"""Table readers with fixed column lists and types."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.operators.contracts import ContractError, duplicate_keys, not_finite, violation

EXACT_DOUBLE = float(1 << 53)
LEDGER_SCHEMA = (
    "result_id string, dataset string, endpoint string, quantity string, full_precision double, display string, status string"
)


def scan_allowed(spark: SparkSession, path: str, allow: Sequence[str]) -> DataFrame:
    """Parquet scan that reads the allowed columns only; everything else never leaves the file."""
    source = spark.read.parquet(path)
    missing = [c for c in allow if c not in source.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return source.select(*allow)


def scan_csv(
    spark: SparkSession, path: str, required: Sequence[str], *, rename: Mapping[str, str] | None = None, integers: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """CSV with a header: required columns, renames, and strict integers.

    Types are never inferred. Returns the table and the violations: values of an
    integer column that are not whole numbers (they are null in the table).
    """
    raw = spark.read.option("header", True).csv(path)
    missing = [c for c in required if c not in raw.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    typed, problems = raw.select(*required), None
    for column in integers:
        exact, number = F.col(column).try_cast("bigint"), F.col(column).try_cast("double")
        # other spellings of whole numbers (3.0, 1e3) only while a double holds them exactly
        spelled = F.when((number == F.floor(number)) & (F.abs(number) < EXACT_DOUBLE), number.cast("bigint"))
        value = F.coalesce(exact, spelled)
        whole = value.isNotNull()
        bad = raw.where(~F.coalesce(whole, F.lit(False))).select(
            *violation("integer", F.lit(column), F.coalesce(F.col(column), F.lit("null")))
        )
        problems = bad if problems is None else problems.unionByName(bad)
        typed = typed.withColumn(column, value)
    for old, new in (rename or {}).items():
        typed = typed.withColumnRenamed(old, new)
    if problems is None:
        problems = raw.limit(0).select(*violation("integer", F.lit(""), F.lit("")))
    return typed, problems


def scan_ledger(spark: SparkSession, path: str, *, multiline: bool = False) -> DataFrame:
    """Result ledger from JSON: one object per line (splittable) or one array per file."""
    return spark.read.schema(LEDGER_SCHEMA).option("multiLine", multiline).json(path)


def ledger_contract(ledger: DataFrame) -> DataFrame:
    """Violations: no rows, repeated ids, non-finite values, values without a display text."""
    empty = ledger.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(*violation("ledger", F.lit("rows"), F.lit("empty")))
    repeated = duplicate_keys(ledger, ["result_id"]).select(*violation("unique_key", F.col("result_id"), F.col("n")))
    problem = F.when(not_finite("full_precision"), F.lit("value")).when(
        F.col("display").isNull() | (F.col("display") == ""), F.lit("display")
    )
    content = ledger.select(*violation("content", F.col("result_id"), problem)).where("detail is not null")
    return empty.unionByName(repeated).unionByName(content)
