"""Sinks: sorted Parquet, CSV with nested cells, a JSON twin of a manifest, and write-once tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from driftgauge.operators.audit import content_hash, same_table
from driftgauge.operators.contracts import ContractError


def write_parquet(df: DataFrame, path: str, sort_cols: Sequence[str]) -> None:
    """Globally sorted by range partitions; refuses an existing path, and the committer publishes all or nothing."""
    df.sort(*sort_cols).write.mode("errorifexists").parquet(path)


def flatten_nested(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(
        *[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema.fields]
    )


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested cells are JSON-encoded and quotes are doubled."""
    flatten_nested(df).write.mode("errorifexists").option("header", True).option("escape", '"').csv(path)


def manifest_summary(df: DataFrame, count_col: str) -> DataFrame:
    """Counts per value and the content digest as one JSON record; no clock in it."""
    counts = df.groupBy(F.col(count_col).cast("string").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    folded = counts.agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("counts"), F.sum("n").alias("n_rows"))
    content = content_hash(df).select(F.col("digest").alias("content_digest"))
    record = folded.join(F.broadcast(content)).select(
        "n_rows", F.to_json("counts").alias("counts"), "content_digest"
    )
    return record.withColumn("record", F.to_json(F.struct("n_rows", "counts", "content_digest")))


def write_json_twin(df: DataFrame, path: str, count_col: str) -> None:
    """``path/rows`` holds the rows as JSON lines, ``path/summary`` the single summary record."""
    df.write.mode("errorifexists").json(f"{path}/rows")
    manifest_summary(df, count_col).select("n_rows", "counts", "content_digest").write.mode("errorifexists").json(f"{path}/summary")


def write_once(df: DataFrame, path: str, *, verify: bool = False) -> str:
    """Write a new table, or show that an existing one is what would be written.

    Returns ``written`` or ``identical``; anything else raises.
    """
    try:
        df.write.mode("errorifexists").parquet(path)
        return "written"
    except AnalysisException as error:
        if "PATH_ALREADY_EXISTS" not in str(error):
            raise
        if not verify:
            raise ContractError(f"{path} exists") from None
    existing = df.sparkSession.read.parquet(path)
    if not same_table(existing.select(*df.columns), df).first()["identical"]:
        raise ContractError(f"{path} differs from what would be written")
    return "identical"
