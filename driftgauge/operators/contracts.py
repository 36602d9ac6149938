"""Input contracts: every check returns rows ``(check, key, detail)``; an empty result means clean.

Checks on values and keys are single aggregates over the table. A contract is
reported in full rather than at its first failure; :func:`assert_clean` raises.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VIOLATION = T.StructType(
    [
        T.StructField("check", T.StringType(), False),
        T.StructField("key", T.StringType(), True),
        T.StructField("detail", T.StringType(), True),
    ]
)


class ContractError(ValueError):
    """An input broke a contract."""


def assert_clean(violations: DataFrame, show: int = 20) -> None:
    """Raise when there is any violation; only the first few rows reach the driver."""
    found = violations.limit(show).collect()
    if found:
        raise ContractError("; ".join(f"{r['check']}[{r['key']}]: {r['detail']}" for r in found))


def violation(check: str, key: Column, detail: Column) -> list[Column]:
    return [F.lit(check).alias("check"), key.cast("string").alias("key"), detail.cast("string").alias("detail")]


def schema_violations(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """Exact ordered column names: missing, unexpected or reordered columns."""
    seen, wanted = list(df.columns), list(expected)
    rows = [("schema", c, "missing") for c in wanted if c not in seen]
    rows += [("schema", c, "unexpected") for c in seen if c not in wanted]
    if not rows and seen != wanted:
        rows.append(("schema", ",".join(seen), "reordered"))
    return df.sparkSession.createDataFrame(rows, VIOLATION)


def leakage_violations(df: DataFrame, names: Sequence[str], tokens: Sequence[str] = ()) -> DataFrame:
    """Columns that would leak the target: exact names, or a token of the name, case-folded."""
    banned = {n.casefold() for n in names}
    parts = {t.casefold() for t in tokens}
    rows = []
    for column in df.columns:
        folded = column.casefold()
        words = set("".join(ch if ch.isalnum() else " " for ch in folded).split())
        if folded in banned:
            rows.append(("leakage", column, "forbidden name"))
        elif words & parts:
            rows.append(("leakage", column, "forbidden token"))
    return df.sparkSession.createDataFrame(rows, VIOLATION)


def not_finite(column: str) -> Column:
    c = F.col(column).cast("double")
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def value_profile(
    df: DataFrame,
    finite: Sequence[str],
    unit_interval: Sequence[str] = (),
    bounds: tuple[float, float] = (0.0, 1.0),
) -> DataFrame:
    """``(column_name, not_finite, out_of_range)`` per column from one pass over the table.

    The range test only looks at finite values: NaN sorts above every number in Spark.
    """
    columns = list(dict.fromkeys([*finite, *unit_interval]))
    low, high = bounds
    aggregates = []
    for column in columns:
        bad = not_finite(column)
        out = ((F.col(column) < low) | (F.col(column) > high)) if column in unit_interval else F.lit(False)
        aggregates += [F.count_if(bad).alias(f"{column}__nf"), F.count_if(~bad & out).alias(f"{column}__oor")]
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.col(f"{c}__nf").alias("not_finite"),
                F.col(f"{c}__oor").alias("out_of_range"),
            )
            for c in columns
        ]
    )
    return df.agg(*aggregates).select(F.explode(entries).alias("e")).select("e.*")


def value_violations(df: DataFrame, finite: Sequence[str], unit_interval: Sequence[str] = ()) -> DataFrame:
    profile = value_profile(df, finite, unit_interval)
    nf = profile.where("not_finite > 0").select(*violation("finite", F.col("column_name"), F.col("not_finite")))
    oor = profile.where("out_of_range > 0").select(*violation("range", F.col("column_name"), F.col("out_of_range")))
    return nf.unionByName(oor)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys…, n)`` for keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def key_profile(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, distinct keys, duplicated keys, rows with an empty key part."""
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(key).isNull() | (F.col(key).cast("string") == "")
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max(empty).alias("empty"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count(F.lit(1)).alias("n_keys"),
        F.count_if(F.col("n") > 1).alias("n_duplicated"),
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("n_empty"),
    )


def key_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    duplicated = duplicate_keys(df, keys).select(*violation("unique_key", text, F.col("n")))
    empty = F.lit(False)
    for key in keys:
        empty = empty | F.col(key).isNull() | (F.col(key).cast("string") == "")
    blank = (
        df.where(empty).groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0")
        .select(*violation("empty_key", F.lit(",".join(keys)), F.col("n")))
    )
    return duplicated.unionByName(blank)


def contract_violations(
    df: DataFrame,
    *,
    keys: Sequence[str],
    finite: Sequence[str],
    unit_interval: Sequence[str] = (),
    ordered_columns: Sequence[str] | None = None,
    forbidden: Sequence[str] = (),
    forbidden_tokens: Sequence[str] = (),
) -> DataFrame:
    """The whole contract of a scored table as one violations table."""
    out = key_violations(df, keys).unionByName(value_violations(df, finite, unit_interval))
    if ordered_columns is not None:
        out = schema_violations(df, ordered_columns).unionByName(out)
    if forbidden or forbidden_tokens:
        out = leakage_violations(df, forbidden, forbidden_tokens).unionByName(out)
    return out


def count_reconcile(df: DataFrame, keys: Sequence[str], expected: DataFrame, expected_col: str = "expected") -> DataFrame:
    """Observed against expected counts; only the groups that differ (missing on either side counts as zero)."""
    observed = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("observed"))
    joined = observed.join(expected.select(*keys, F.col(expected_col).alias("expected")), list(keys), "full_outer")
    return joined.select(
        *keys,
        F.coalesce("observed", F.lit(0)).cast("bigint").alias("observed"),
        F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
    ).where("observed <> expected")


def unsafe_path(path: Column | str) -> Column:
    """True for a path that is null, blank, absolute or climbs out with ``..``."""
    path = F.col(path) if isinstance(path, str) else path
    return path.isNull() | (path == "") | path.startswith("/") | F.array_contains(F.split(path, "/"), "..")


def identifier_number(column: Column | str, pattern: str, group: int = 1) -> Column:
    """The integer captured by ``pattern``, or null when the text does not match."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.rlike(pattern), F.regexp_extract(column, pattern, group).try_cast("bigint"))


def mapping_violations(df: DataFrame, code_col: str, name_col: str, expected: Mapping[str, str]) -> DataFrame:
    """Codes with several names, codes whose name differs from the expected map, and expected codes not seen."""
    code, name = F.col(code_col).cast("string"), F.col(name_col).cast("string")
    seen = df.groupBy(code.alias("code")).agg(
        F.count_distinct(name).alias("n_names"), F.min(name).alias("first_name")
    )
    wanted = df.sparkSession.createDataFrame(list(expected.items()), "code string, expected_name string")
    joined = seen.join(wanted, "code", "full_outer")
    problem = (
        F.when(F.col("n_names").isNull(), F.lit("code not seen"))
        .when(F.col("expected_name").isNull(), F.lit("unexpected code"))
        .when(F.col("n_names") > 1, F.lit("several names"))
        .when(~F.col("first_name").eqNullSafe(F.col("expected_name")), F.lit("wrong name"))
    )
    return joined.select(*violation("mapping", F.col("code"), problem)).where("detail is not null")


def population_profile(df: DataFrame, population_col: str, id_col: str) -> DataFrame:
    """One row: number of populations, its name, rows, distinct ids.

    Counted by (id, population) first, so the final aggregate sees combined rows only.
    """
    return df.agg(
        F.count_distinct(population_col).alias("n_populations"),
        F.min(population_col).alias("population"),
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(id_col).alias("n_ids"),
    )


def population_violations(
    df: DataFrame, population_col: str, id_col: str, population: str, expected_n: int | None = None
) -> DataFrame:
    """Exactly one population, the named one, with unique ids and, if given, the expected size."""
    profile = population_profile(df, population_col, id_col)
    problems = F.array_compact(
        F.array(
            F.when(F.col("n_rows") == 0, F.lit("empty")),
            F.when(F.col("n_populations") > 1, F.lit("several populations")),
            F.when(F.col("population") != population, F.lit("wrong population")),
            F.when(F.col("n_rows") != F.col("n_ids"), F.lit("duplicated ids")),
            F.when(F.col("n_rows") != (F.lit(expected_n) if expected_n is not None else F.col("n_rows")), F.lit("wrong count")),
        )
    )
    return profile.select(F.col("population"), F.explode(problems).alias("problem")).select(
        *violation("population", F.col("population"), F.col("problem"))
    )
