"""Content fingerprints, duplicate groups and one-to-one matching."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftgauge.functions import set_digest

EXACT, EQUIVALENT, AMBIGUOUS, NO_MATCH = "EXACT", "EQUIVALENT", "AMBIGUOUS", "NO_MATCH"
AUTHORITATIVE = (EXACT, EQUIVALENT)


def array_fingerprints(elements: DataFrame, case_col: str, coord_cols: Sequence[str], value_col: str) -> DataFrame:
    """Digest of a dense array per case, independent of storage type and row order.

    A member is the coordinates and the value as a double, so position counts; the
    extent along every axis is part of the digest, so equal values in another shape
    differ. State per case is a few numbers.
    """
    member = F.concat_ws(",", *[F.col(c).cast("bigint").cast("string") for c in coord_cols], F.col(value_col).cast("double").cast("string"))
    shape = F.concat_ws("x", *[(F.max(c) + 1).cast("string") for c in coord_cols])
    return elements.groupBy(case_col).agg(shape.alias("shape"), set_digest(member).alias("members")).select(
        case_col, "shape", F.sha2(F.concat_ws("|", "shape", "members"), 256).alias("fingerprint")
    )


def one_to_one_matches(left: DataFrame, right: DataFrame, id_col: str, canonical_col: str, raw_col: str) -> DataFrame:
    """Classify each left record by its canonical hash.

    Both sides are reduced to one row per hash first, so a hash shared by a third of
    all rows never forms pairs: any collision on either side is ``AMBIGUOUS``.
    """
    def per_hash(side: DataFrame, tag: str) -> DataFrame:
        return side.groupBy(canonical_col).agg(
            F.count(F.lit(1)).alias(f"{tag}_n"), F.min(id_col).alias(f"{tag}_id"), F.min(raw_col).alias(f"{tag}_raw")
        )

    classes = per_hash(left, "l").join(per_hash(right, "r"), canonical_col, "left").select(
        canonical_col,
        F.when(F.col("r_n").isNull(), F.lit(NO_MATCH))
        .when((F.col("r_n") > 1) | (F.col("l_n") > 1), F.lit(AMBIGUOUS))
        .when(F.col("l_raw") == F.col("r_raw"), F.lit(EXACT))
        .otherwise(F.lit(EQUIVALENT))
        .alias("status"),
        "r_id",
    )
    # records without a hash have no class; they match nothing
    return left.join(classes, canonical_col, "left").withColumn("status", F.coalesce("status", F.lit(NO_MATCH))).select(
        id_col, "status", F.when(F.col("status").isin(*AUTHORITATIVE), F.col("r_id")).alias("matched_id")
    )


def authoritative(matches: DataFrame, statuses: Sequence[str] = AUTHORITATIVE) -> DataFrame:
    """Matches that may be used as provenance: those with one of the accepted statuses."""
    return matches.where(F.col("status").isin(*statuses))


def units_with_several_cases(df: DataFrame, scope_col: str, unit_col: str, case_col: str) -> DataFrame:
    """Cases of every unit that has more than one inside its scope, in long form ``(scope, unit, n_cases, case)``.

    Long form: a unit with very many cases stays many rows instead of one huge array.
    """
    cases = df.select(scope_col, unit_col, case_col).distinct()
    several = cases.groupBy(scope_col, unit_col).agg(F.count(F.lit(1)).alias("n_cases")).where("n_cases > 1")
    return cases.join(several, [scope_col, unit_col])


def cross_scope_units(df: DataFrame, scope_col: str, global_col: str) -> DataFrame:
    """Global ids seen in several scopes; blank ids are not ids."""
    named = df.where(F.col(global_col).isNotNull() & (F.trim(F.col(global_col).cast("string")) != ""))
    return (
        named.select(global_col, scope_col).distinct().groupBy(global_col)
        .agg(F.count(F.lit(1)).alias("n_scopes"), F.array_join(F.sort_array(F.collect_set(scope_col)), ",").alias("scopes"))
        .where("n_scopes > 1")
    )


def duplicate_groups(df: DataFrame, content_col: str, id_col: str) -> DataFrame:
    """Groups of identical content by hash, with size and smallest id."""
    return (
        df.select(id_col, F.sha2(F.col(content_col).cast("string"), 256).alias("content_hash"))
        .groupBy("content_hash")
        .agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"))
        .where("n > 1")
    )
