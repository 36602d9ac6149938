"""File inventories, digests and their reconciliation, read through Spark's file listing."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftgauge.functions import set_digest
from driftgauge.session import compute_tasks

# A binary row holds a whole file, some three times; larger files are read as streams.
ROW_FILE_BYTES = 16 << 20
# The largest row where tasks cannot open files themselves.
MAX_FILE_BYTES = 1 << 30
CHUNK_BYTES = 8 << 20


def _files(spark: SparkSession, root: str, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root)


def _relative(root: str):
    """The path below ``root``, whatever scheme Spark puts in front."""
    tail = root.split("://")[-1].removeprefix("file:").rstrip("/") + "/"
    return F.expr("substring(path, locate(:tail, path) + length(:tail))".replace(":tail", "'" + tail.replace("'", "\\'") + "'"))


def inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, length)`` of every file below ``root``; contents are not read."""
    return _files(spark, root, glob).select(_relative(root).alias("path"), "length")


def entities(files: DataFrame, entity_pattern: str, kinds: Mapping[str, str]) -> DataFrame:
    """One row per entity folder: number of files and, per kind, how many files match its pattern.

    ``has_<kind>`` is true for at least one file, ``repeated_<kind>`` for more than one.
    """
    found = files.withColumn("entity", F.regexp_extract("path", entity_pattern, 1)).where("entity <> ''")
    counts = found.groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_files"), *[F.count_if(F.col("path").rlike(p)).alias(f"n_{k}") for k, p in kinds.items()]
    )
    return counts.select(
        "entity", "n_files",
        *[(F.col(f"n_{k}") > 0).alias(f"has_{k}") for k in kinds],
        *[(F.col(f"n_{k}") > 1).alias(f"repeated_{k}") for k in kinds],
    )


def digests(spark: SparkSession, root: str, glob: str | None = None, algorithm: str = "sha256", tasks: int | None = None) -> DataFrame:
    """``(path, length, digest)`` of files of any size; ``tasks`` is the most tasks that read them, for many files that are known to be small.

    Spark counts each file as 4 MB at least, which gives a task to every 32 small files.

    Files up to ``ROW_FILE_BYTES`` are hashed from their binary row (the length filter reaches the source, so larger
    contents are never loaded); larger ones are read by tasks as streams in chunks. In a store that only Spark opens the limit is ``MAX_FILE_BYTES``.
    """
    files = _files(spark, root, glob)
    real = _real_root(spark, root)
    most = min(ROW_FILE_BYTES, MAX_FILE_BYTES) if real else MAX_FILE_BYTES
    if tasks:
        files = files.coalesce(tasks)
    content = F.col("content")
    value = {"sha256": F.sha2(content, 256), "md5": F.md5(content)}[algorithm]
    small = files.where(F.col("length") <= most).select("path", "length", value.alias("digest"))

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(digest=[_streamed_digest(_moved(p, real), algorithm) for p in frame["path"]])

    # one row per large file, dealt evenly because each is long work
    large = files.where(F.col("length") > most).select("path", "length").repartition(compute_tasks(spark))
    hashed = small.unionByName(large.mapInPandas(stream, "path string, length bigint, digest string"))
    return hashed.select(_relative(root).alias("path"), "length", "digest")


def _real_root(spark: SparkSession, root: str) -> tuple[str, str] | None:
    """The root as Spark lists it and as it is without mount points, if the store it is in then can be opened without Spark."""
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)  # noqa: SLF001
        system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())  # noqa: SLF001
        listed, real = system.makeQualified(path).toString(), system.resolvePath(path).toString()
        _store(real)
    except Exception:  # noqa: BLE001 - no such path, or a store that is unknown here: Spark reads it, or says what is wrong
        return None
    return listed.rstrip("/") + "/", real.rstrip("/") + "/"


def _moved(path: str, real: tuple[str, str] | None) -> str:
    return real[1] + path.removeprefix(real[0]) if real and path.startswith(real[0]) else path


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    server, _, inner = rest.removeprefix("//").partition("/")
    system, base = fs.FileSystem.from_uri(f"{scheme}://{server}/")
    return system, f"{base.rstrip('/')}/{inner}"


def _streamed_digest(path: str, algorithm: str) -> str:
    system, inner = _store(path)
    source = system.open_input_stream(inner, compression=None)
    digest = hashlib.new(algorithm, usedforsecurity=False)
    with source:
        while chunk := source.read(CHUNK_BYTES):
            digest.update(chunk)
    return digest.hexdigest()


def reconcile(observed: DataFrame, expected: DataFrame) -> DataFrame:
    """Files that are missing, unexpected, not hashed, or differ in size or digest."""
    e = expected.select("path", F.col("length").alias("want_length"), F.col("digest").alias("want_digest"))
    status = (
        F.when(F.col("length").isNull(), F.lit("missing"))
        .when(F.col("want_length").isNull(), F.lit("unexpected"))
        .when(F.col("length") != F.col("want_length"), F.lit("size"))
        .when(F.col("digest").isNull(), F.lit("not_hashed"))
        .when(F.col("digest") != F.col("want_digest"), F.lit("digest"))
    )
    return observed.join(e, "path", "full_outer").select("path", status.alias("status")).where("status is not null")


def tree_digest(hashed: DataFrame) -> DataFrame:
    """One digest over all (path, file digest) pairs, with the number of files."""
    pair = F.concat_ws(" ", "path", F.coalesce("digest", F.lit("-")))
    return hashed.agg(F.count(F.lit(1)).alias("n_files"), set_digest(pair).alias("digest"))
