"""Splits, repeated folds, the unit bootstrap and alignment by key.

All randomness is a hash of (seed, key), so results do not depend on partitioning,
row order or re-execution, and plain SQL can reproduce them.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftgauge.functions import hash_uniform
from driftgauge.operators.audit import key_reconcile
from driftgauge.operators.contracts import ContractError, value_violations, violation
from driftgauge.operators.ranks import BLOCK, group_sizes, hash_positions, needs_blocks, parts_by_boundaries, quantiles, range_blocks
from driftgauge.session import compute_tasks, measured_broadcast

# Resampling protocol.
BOOTSTRAP_RESAMPLES = 2000
BOOTSTRAP_SEED = 2026
CONFIDENCE_LEVEL = 0.95
CROSSFIT_FOLDS = 5
CROSSFIT_SEEDS = tuple(range(2026, 2036))


def fold_of(position: Column, size: Column, k: int) -> Column:
    """Contiguous balanced blocks: the first ``size mod k`` folds hold one row more."""
    small = F.floor(size / F.lit(k)).cast("bigint")
    extra = size % F.lit(k)
    cut = extra * (small + 1)
    early = F.floor(position / (small + 1))
    late = extra + F.floor((position - cut) / F.greatest(small, F.lit(1)))
    return F.when(position < cut, early).otherwise(late).cast("int")


def _fold_end(size: Column, folds: int, k: int) -> Column:
    """Place of the last row of the first ``folds`` of ``k`` folds."""
    return F.lit(folds) * F.floor(size / F.lit(k)) + F.least(F.lit(folds), size % F.lit(k)) - 1


def repeated_folds(
    units: DataFrame,
    group_cols: Sequence[str],
    id_col: str,
    seeds: Sequence[int] = CROSSFIT_SEEDS,
    k: int = CROSSFIT_FOLDS,
    *,
    folds_col: str = "folds",
    blocks: bool | None = None,
) -> DataFrame:
    """Attach an array with one fold number per seed; each repeat is an independent balanced K-fold.

    The k-1 rows where the folds of a repeat end are selected from counts of hash buckets, and every row is compared with them in one narrow pass.
    Ids must be unique inside their group. With over a thousand groups, whole groups are ordered instead.
    """
    group_cols = list(group_cols)
    found = parts_by_boundaries(units, group_cols, id_col, seeds, lambda n: [_fold_end(n, j, k) for j in range(1, k)], folds_col)
    if found is not None:
        return found
    if blocks is None:
        blocks = needs_blocks(units, group_cols)
    tagged = units.select(
        *group_cols, id_col, F.posexplode(F.array(*[F.lit(int(s)) for s in seeds])).alias("repeat", "seed")
    )
    placed = hash_positions(tagged, [*group_cols, "repeat"], id_col, F.col("seed"), blocks=blocks)
    arrays = (
        placed.withColumn("fold", fold_of(F.col("position"), F.col("size"), k))
        .groupBy(*group_cols, id_col)
        .agg(F.sort_array(F.collect_list(F.struct("repeat", "fold"))).alias("__a"))
        .select(*group_cols, id_col, F.transform("__a", lambda e: e["fold"]).alias(folds_col))
    )
    return units.join(arrays, [*group_cols, id_col])


def long_folds(units: DataFrame, keep: Sequence[str], folds_col: str = "folds") -> DataFrame:
    """One row per unit and repeat."""
    return units.select(*keep, F.posexplode(folds_col).alias("repeat", "fold"))


def align_folds(folds: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Folds of exactly the supplied ids, and the ids present on one side only (must be empty)."""
    return folds.join(ids.select(id_col), id_col), key_reconcile(ids, folds, [id_col])


def _bands(quotas: DataFrame, stratum_col: str) -> DataFrame:
    ordered = W.partitionBy(stratum_col).orderBy("role_order")
    stop = F.sum("quota").over(ordered.rowsBetween(W.unboundedPreceding, W.currentRow))
    return quotas.select(stratum_col, "role", (stop - F.col("quota")).alias("__start"), stop.alias("__stop"))


def quota_split(
    units: DataFrame, stratum_col: str, id_col: str, quotas: DataFrame, seed: Column | int, *, blocks: bool | None = None
) -> DataFrame:
    """Fixed quotas per stratum: order by hash, then cut the order into roles.

    ``quotas`` is ``(stratum, role, role_order, quota)``. Pass a seed column that
    includes the stratum for independent orders, or a constant to restart the same
    order in every stratum. Quotas that do not use up every stratum exactly are refused, so
    that each row gets a role.
    """
    problems = quota_violations(units, stratum_col, quotas).take(5)
    if problems:
        raise ContractError(f"quotas do not fit: {[tuple(p) for p in problems]}")
    placed = hash_positions(units, [stratum_col], id_col, seed, blocks=blocks)
    return (
        placed.join(measured_broadcast(_bands(quotas, stratum_col)), stratum_col)
        .where((F.col("position") >= F.col("__start")) & (F.col("position") < F.col("__stop")))
        .drop("position", "size", "__start", "__stop")
    )


def quota_violations(units: DataFrame, stratum_col: str, quotas: DataFrame) -> DataFrame:
    """Strata whose quotas are negative or do not use up the stratum exactly."""
    seen = units.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("n"))
    wanted = quotas.groupBy(stratum_col).agg(F.sum("quota").alias("q"), F.min("quota").alias("q_min"))
    joined = seen.join(wanted, stratum_col, "full_outer")
    bad = ~F.col("n").eqNullSafe(F.col("q")) | (F.col("q_min") < 0)
    return joined.where(bad).select(
        *violation("quota", F.col(stratum_col), F.concat(F.lit("rows "), F.coalesce("n", F.lit(0)), F.lit(" quota "), F.coalesce("q", F.lit(0))))
    )


def apportion(strata: DataFrame, stratum_col: str, sizes: Mapping[str, int]) -> DataFrame:
    """Split each role's size over the strata by largest remainder, ties by stratum name.

    Works on the table of stratum counts ``(stratum, n)``, which has one row per
    stratum. Roles are served in order; the last one takes what is left.
    """
    roles = list(sizes)
    everything = W.partitionBy(F.lit(1))
    left = strata.select(stratum_col, F.col("n").cast("bigint").alias("__left"))
    parts: list[DataFrame] = []
    table = left
    for order, role in enumerate(roles):
        target = int(sizes[role])
        if order == len(roles) - 1:
            table = table.withColumn(role, F.col("__left"))
            continue
        exact = F.lit(target) * F.col("__left") / F.sum("__left").over(everything)
        table = table.withColumn("__q", exact.cast("double")).withColumn("__base", F.floor("__q").cast("bigint"))
        place = F.row_number().over(everything.orderBy(F.desc(F.col("__q") - F.col("__base")), F.col(stratum_col)))
        slots = F.lit(target) - F.sum("__base").over(everything)
        table = (
            table.withColumn("__place", place).withColumn("__slots", slots)
            .withColumn(role, F.col("__base") + (F.col("__place") <= F.col("__slots")).cast("bigint"))
            .withColumn("__left", F.col("__left") - F.col(role))
            .drop("__q", "__base", "__place", "__slots")
        )
    entries = [F.struct(F.lit(r).alias("role"), F.lit(i).alias("role_order"), F.col(r).alias("quota")) for i, r in enumerate(roles)]
    return table.select(stratum_col, F.explode(F.array(*entries)).alias("e")).select(stratum_col, "e.*")


def proportional_split(units: DataFrame, stratum_col: str, id_col: str, sizes: Mapping[str, int], seed: int) -> DataFrame:
    """Stratified split whose role sizes hold exactly over the whole table."""
    strata = units.groupBy(stratum_col).agg(F.count(F.lit(1)).alias("n"))
    return quota_split(units, stratum_col, id_col, apportion(strata, stratum_col, sizes), stratum_seed(seed, stratum_col))


def stratum_seed(seed: int, stratum_col: str) -> Column:
    return F.concat_ws("/", F.lit(str(seed)), F.col(stratum_col).cast("string"))


def stratified_folds(units: DataFrame, stratum_col: str, id_col: str, k: int, seed: int, *, blocks: bool | None = None) -> DataFrame:
    """Balanced folds inside every stratum: consecutive runs of the stratum's hash order."""
    placed = hash_positions(units, [stratum_col], id_col, stratum_seed(seed, stratum_col), blocks=blocks)
    return placed.withColumn("fold", fold_of(F.col("position"), F.col("size"), k)).drop("position", "size")


PLACE_COLUMNS = ("__pos", "__base", "__n", "__slot")


def place_units(
    units: DataFrame, group_cols: Sequence[str], id_col: str, seed: int = BOOTSTRAP_SEED, *, blocks: bool | None = None
) -> DataFrame:
    """Give every unit its place ``__pos`` in 0..n-1, its group size ``__n`` and a slot number.

    ``__slot`` is unique over all groups (group offset plus place), so draws travel and
    join by one BIGINT. The rows are spread evenly by slot: the order was found group
    by group, but drawing must not stay on those few tasks.
    """
    group_cols = list(group_cols)
    placed = hash_positions(units, group_cols, id_col, seed, position_col="__pos", size_col="__n", blocks=blocks)
    sizes = group_sizes(units, group_cols)
    if sizes is None:
        counts = units.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("__c"))
        before = W.partitionBy(F.lit(1)).orderBy(*group_cols).rowsBetween(W.unboundedPreceding, -1)
        bases = counts.select(*group_cols, F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"))
        placed = placed.join(bases, group_cols)
    else:
        base, offset = None, 0
        for key, n in sorted(sizes.items(), key=lambda item: tuple(map(str, item[0]))):
            own = F.lit(True)
            for column, value in zip(group_cols, key):
                own = own & F.col(column).eqNullSafe(F.lit(value))
            base = F.when(own, F.lit(offset)) if base is None else base.when(own, F.lit(offset))
            offset += n
        placed = placed.withColumn("__base", (F.lit(0) if base is None else base).cast("bigint"))
    placed = placed.withColumn("__slot", F.col("__base") + F.col("__pos"))
    return placed.repartition(compute_tasks(units.sparkSession), "__slot")


def draw(
    placed: DataFrame, group_cols: Sequence[str], id_col: str, *, resamples: int, seed: int, mode: str = "multinomial", include_original: bool = False
) -> DataFrame:
    """Replicates of placed units: their columns plus ``replicate`` (1..B) and ``multiplicity``."""
    group_cols = list(group_cols)
    units = placed.drop(*PLACE_COLUMNS)
    if mode == "poisson":
        numbers = F.explode(F.sequence(F.lit(1), F.lit(int(resamples)))).alias("replicate")
        u = hash_uniform(F.lit(seed), *group_cols, "replicate", id_col)
        # the hash is made once a row: as a plain column it would be repeated by the filter and by the cases
        hashed = units.select("*", numbers).select("*", F.explode(F.array(u)).alias("__u")).where(F.col("__u") >= POISSON_TOTALS[0])
        out = hashed.withColumn("multiplicity", _poisson_one(F.col("__u"))).drop("__u")
    elif mode == "multinomial":
        # One md5 has room for two draws, so replicates 2j - 1 and 2j share the hash of j.
        pairs = F.explode(F.sequence(F.lit(1), F.lit((int(resamples) + 1) // 2))).alias("__pair")
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in group_cols], F.col("__pair").cast("string"), F.col("__pos").cast("string")))
        slots = placed.select(*group_cols, "__pos", "__base", "__n", pairs).select("__pair", "__base", "__n", digest.alias("__digest"))

        def half(start: int) -> Column:
            return F.col("__base") + F.pmod(F.conv(F.substring("__digest", start, 15), 16, 10).cast("bigint"), F.col("__n"))

        both = F.array(
            F.struct((F.col("__pair") * 2 - 1).alias("replicate"), half(1).alias("__slot")),
            F.struct((F.col("__pair") * 2).alias("replicate"), half(16).alias("__slot")),
        )
        draws = (
            slots.select(F.explode(both).alias("d")).select("d.*").where(F.col("replicate") <= int(resamples))
            .repartition(compute_tasks(placed.sparkSession), "__slot")
            .groupBy("__slot", "replicate")
            .agg(F.count(F.lit(1)).alias("multiplicity"))
        )
        out = placed.drop("__pos", "__base", "__n").join(draws, "__slot").drop("__slot")
    else:
        raise ValueError(f"unknown bootstrap mode: {mode}")
    if include_original:
        original = units.withColumns({"replicate": F.lit(0), "multiplicity": F.lit(1).cast("bigint")})
        out = out.unionByName(original)
    return out


def bootstrap(
    units: DataFrame,
    group_cols: Sequence[str],
    id_col: str,
    *,
    resamples: int = BOOTSTRAP_RESAMPLES,
    seed: int = BOOTSTRAP_SEED,
    mode: str = "multinomial",
    include_original: bool = False,
    blocks: bool | None = None,
) -> DataFrame:
    """Unit bootstrap per group.

    ``multinomial`` draws exactly n units with replacement per group and replicate:
    every unit's place is also a slot, each slot draws a place by hash, and draws are
    counted per place. Draws are shuffled once, by the same key the units are joined
    on. ``poisson`` gives every unit an independent Poisson(1) count without any
    shuffle; group sizes then vary. Copies are never materialised.
    ``include_original`` adds replicate 0, the sample itself.
    """
    if mode == "poisson":
        # every unit is read once and hashed for each replicate: that work is spread, not the bytes
        placed = units.repartition(compute_tasks(units.sparkSession), id_col)
    else:
        placed = place_units(units, group_cols, id_col, seed, blocks=blocks)
    return draw(placed, group_cols, id_col, resamples=resamples, seed=seed, mode=mode, include_original=include_original)


def _poisson_totals() -> tuple[float, ...]:
    weight, total, out = 0.36787944117144233, 0.0, []
    for count in range(18):
        total += weight
        weight /= count + 1
        out.append(total)
    return tuple(out)


# Distribution function of Poisson(1) at 0..17; the tail beyond is below 2**-52.
POISSON_TOTALS = _poisson_totals()


def _poisson_one(u: Column) -> Column:
    """Inverse of the Poisson(1) distribution function."""
    expr = None
    for count, total in enumerate(POISSON_TOTALS):
        test = u < F.lit(total)
        expr = F.when(test, F.lit(count)) if expr is None else expr.when(test, F.lit(count))
    return expr.otherwise(F.lit(18)).cast("bigint")


def inherit_folds(replicates: DataFrame, folds: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Copies of a unit keep the unit's folds: a join on the unit key, never a new assignment."""
    return replicates.join(folds, list(key_cols))


def inheritance_violations(copies: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """(replicate, repeat, unit) whose copies lie in several folds."""
    return copies.groupBy(*key_cols).agg(F.min("fold").alias("lo"), F.max("fold").alias("hi")).where("lo <> hi")


def copy_ordinals(df: DataFrame, id_col: str, position_col: str) -> DataFrame:
    """Zero-based occurrence number of a repeated id in the order of ``position_col``.

    Where an id has more rows than a task holds, rows are sorted by ranges of (id, position): the rows of an id in earlier ranges are
    counted, and numbers inside a range come on top. For replicate tables use :func:`expand_copies`, which needs no sort.
    """
    if not needs_blocks(df, [id_col]):
        return df.withColumn("ordinal", F.row_number().over(W.partitionBy(id_col).orderBy(position_col)) - 1)
    pinned = range_blocks(df, [id_col, position_col])
    before = W.partitionBy(id_col).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    counts = pinned.groupBy(id_col, BLOCK).agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select(F.col(id_col).alias("__id"), F.col(BLOCK).alias("__in"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__offset"))
    inside = W.partitionBy(id_col, BLOCK).orderBy(position_col)
    placed = pinned.join(offsets, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col(BLOCK) == F.col("__in")))
    ordinal = (F.col("__offset") + F.row_number().over(inside) - 1).cast("int")
    return placed.withColumn("ordinal", ordinal).drop(BLOCK, "__id", "__in", "__offset")


def expand_copies(replicates: DataFrame) -> DataFrame:
    """One row per copy with its ordinal, from multiplicities."""
    return replicates.select("*", F.explode(F.expr("sequence(0L, multiplicity - 1)")).alias("ordinal"))


def align_vectors(vectors: Mapping[str, DataFrame], id_col: str, value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Join named vectors on their exact id set. Returns the wide table and the violations."""
    names = list(vectors)
    first = vectors[names[0]]
    wide = first.select(id_col, F.col(value_col).alias(names[0]))
    problems = value_violations(first, [value_col])
    for name in names[1:]:
        other = vectors[name]
        wide = wide.join(other.select(id_col, F.col(value_col).alias(name)), id_col)
        sides = key_reconcile(first, other, [id_col])
        problems = problems.unionByName(value_violations(other, [value_col])).unionByName(
            sides.select(*violation(f"align:{name}", F.col(id_col), F.col("status")))
        )
    return wide, problems


def percentile_interval(
    df: DataFrame, group_cols: Sequence[str], value_col: str, confidence: float = CONFIDENCE_LEVEL
) -> DataFrame:
    """Two-sided percentile interval with linear interpolation."""
    tail = (1.0 - confidence) / 2.0
    return quantiles(df, group_cols, value_col, {"ci_low": tail, "ci_high": 1.0 - tail})
