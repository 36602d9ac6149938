"""Intermediate tables that several passes read, written once to the shared folder."""
from __future__ import annotations

from pyspark.sql import DataFrame

from driftgauge.session import collected, remove_path, scratch_path  # noqa: F401


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder, by ``folders`` of those columns, and read it back; survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*folders).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path  # noqa: SLF001
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more: what was made from them has been written."""
    for table in tables:
        remove_path(table.sparkSession, table._stored_at)  # noqa: SLF001
