"""Dataset audit: expansion, completeness, validated joins, counts, set reconciliation and fingerprints."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftgauge.functions import max_abs_diff, row_digest, set_digest, within_tolerance
from driftgauge.operators.contracts import key_violations, violation
from driftgauge.operators.ranks import medians
from driftgauge.session import cut_lineage, measured_broadcast


def expand_phases(df: DataFrame, phases: Mapping[str, str], key_col: str, *, case_col: str = "case_id") -> DataFrame:
    """One row per unit and phase: ``phases`` maps the phase name to the column holding its value."""
    entries = [F.struct(F.lit(p).alias("phase"), F.col(c).alias("phase_value")) for p, c in phases.items()]
    rest = [c for c in df.columns if c not in phases.values()]
    return df.select(*rest, F.explode(F.array(*entries)).alias("e")).select(
        *rest,
        "e.phase",
        "e.phase_value",
        F.concat_ws("__", F.col(key_col).cast("string"), F.col("e.phase")).alias(case_col),
    )


def group_completeness(df: DataFrame, unit_col: str, phase_col: str, required: Sequence[str], constant_col: str | None = None) -> DataFrame:
    """Per unit: rows, distinct phases, whether it has exactly the required phases once each, one constant value.

    Counted per (unit, phase) first: the per-unit state is as small as the set of phases.
    """
    constants = [F.min(constant_col).alias("lo"), F.max(constant_col).alias("hi")] if constant_col else []
    per_phase = df.groupBy(unit_col, phase_col).agg(F.count(F.lit(1)).alias("n"), *constants)
    known = F.col(phase_col).isin(list(required))
    varies = F.coalesce(F.min("lo") != F.max("hi"), F.lit(False)) if constant_col else F.lit(False)
    return per_phase.groupBy(unit_col).agg(
        F.sum("n").alias("n_rows"),
        F.count(F.lit(1)).alias("n_phases"),
        F.count_if(~known).alias("n_unknown"),
        F.count_if(F.col("n") > 1).alias("n_repeated"),
        (
            (F.count(F.lit(1)) == len(required)) & (F.count_if(~known) == 0) & (F.count_if(F.col("n") > 1) == 0) & ~varies
        ).alias("complete"),
    )


def phase_means(df: DataFrame, unit_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Mean of every value over the phases of a unit, with the number of phases."""
    return df.groupBy(*unit_cols).agg(F.count(F.lit(1)).alias("n_phases"), *[F.avg(c).alias(c) for c in value_cols])


def phase_identity(df: DataFrame, first_col: str, second_col: str, unlabeled: Column) -> DataFrame:
    """Phases are unambiguous when annotated and different; the annotation role follows the partition."""
    return df.withColumns(
        {
            "phase_unambiguous": ~unlabeled & (F.col(first_col) != F.col(second_col)),
            "annotation_role": F.when(unlabeled, F.lit("unlabeled_excluded")).otherwise(F.lit("annotated")),
        }
    )


def assign_roles(
    df: DataFrame,
    key_col: str,
    source: Column,
    assignment: DataFrame,
    evaluation_roles: Mapping[str, Column],
    excluded: Column,
    reason: str,
) -> DataFrame:
    """Role, split and exclusion reason; rows that fit no rule keep nulls.

    ``assignment`` is ``(key, split)`` for the source rows.
    """
    role = F.when(source, F.lit("SOURCE"))
    for name, condition in evaluation_roles.items():
        role = role.when(condition, F.lit(name))
    joined = df.join(assignment.select(key_col, F.col("split").alias("__split")), key_col, "left")
    return joined.withColumns(
        {
            "role": role,
            "source_split": F.when(source, F.col("__split")),
            "exclusion_reason": F.when(excluded, F.lit(reason)),
            "in_population": role.isNotNull(),
        }
    ).drop("__split")


def union_cohorts(cohorts: Mapping[str, DataFrame], roles: Sequence[str] | None = None) -> DataFrame:
    """Union of cohorts with a ``role`` column, optionally only some roles."""
    out: DataFrame | None = None
    for role, cohort in cohorts.items():
        if roles is not None and role not in roles:
            continue
        tagged = cohort.withColumn("role", F.lit(role))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no cohort selected")
    return out


def one_to_one_join(left: DataFrame, right: DataFrame, key_col: str, how: str = "full_outer") -> DataFrame:
    """Outer or left join with a match indicator. Keys must be unique on both sides: see
    :func:`one_to_one_violations`, which reports the ones that are not."""
    l = left.withColumn("__l", F.lit(True))
    r = right.withColumn("__r", F.lit(True))
    indicator = (
        F.when(F.col("__l").isNull(), F.lit("right_only")).when(F.col("__r").isNull(), F.lit("left_only")).otherwise(F.lit("both"))
    )
    return l.join(r, key_col, how).withColumn("match", indicator).drop("__l", "__r")


def one_to_one_violations(left: DataFrame, right: DataFrame, key_col: str) -> DataFrame:
    l = key_violations(left.select(key_col), [key_col]).withColumn("check", F.concat(F.lit("left_"), "check"))
    r = key_violations(right.select(key_col), [key_col]).withColumn("check", F.concat(F.lit("right_"), "check"))
    return l.unionByName(r)


def label_table(elements: DataFrame, case_cols: Sequence[str], label_col: str) -> DataFrame:
    """Element counts per case and label; the base of every label tabulation."""
    return elements.groupBy(*case_cols, label_col).agg(F.count(F.lit(1)).alias("n_elements"))


def label_summary(elements: DataFrame, case_cols: Sequence[str], label_col: str, expected: Sequence[int], required: Sequence[int]) -> DataFrame:
    """Per case: label counts as a map, observed / unexpected / missing labels and whether every required label occurs."""
    counts = label_table(elements, case_cols, label_col)
    wanted = F.array(*[F.lit(int(v)).cast("bigint") for v in expected])
    needed = F.array(*[F.lit(int(v)).cast("bigint") for v in required])
    entry = F.struct(F.col(label_col).cast("bigint").alias("label"), "n_elements")
    return (
        counts.groupBy(*case_cols)
        .agg(F.sort_array(F.collect_list(entry)).alias("entries"))
        .select(
            *case_cols,
            F.map_from_entries("entries").alias("label_counts"),
            F.transform("entries", lambda e: e["label"]).alias("observed"),
        )
        .withColumns(
            {
                "unexpected": F.array_except("observed", wanted),
                "missing": F.array_except(needed, "observed"),
                "has_required": F.size(F.array_except(needed, "observed")) == 0,
            }
        )
    )


def geometry_comparison(df: DataFrame, pairs: Mapping[str, tuple[str, str]], shapes: tuple[str, str], tolerance: float) -> DataFrame:
    """Exact shape match plus element-wise tolerance tests and largest differences for array columns."""
    out, compatible = df, F.col(shapes[0]) == F.col(shapes[1])
    for name, (left, right) in pairs.items():
        out = out.withColumn(f"{name}_ok", within_tolerance(left, right, tolerance)).withColumn(
            f"{name}_max_diff", max_abs_diff(left, right)
        )
        compatible = compatible & F.col(f"{name}_ok")
    return out.withColumn("compatible", F.coalesce(compatible, F.lit(False)))


def geometry_fingerprint(
    fields: Mapping[str, Column], rounded: Mapping[str, Column], digits: int = 10, lists: Mapping[str, Column] | None = None
) -> Column:
    """sha256 of a canonical text: ``name=value`` in name order; arrays (``lists``, and ``rounded`` with real members as whole numbers of ``10 ** -digits``) in brackets."""
    unit = F.lit(10.0**digits)
    listed = lambda col: F.concat(F.lit("["), F.array_join(F.transform(col, lambda v: v.cast("string")), ","), F.lit("]"))
    texts = {name: listed(F.transform(col, lambda v: F.round(v.cast("double") * unit).cast("bigint"))) for name, col in rounded.items()}
    texts.update({name: listed(col) for name, col in (lists or {}).items()})
    texts.update({name: col.cast("string") for name, col in fields.items()})
    return F.sha2(F.concat_ws("|", *[F.concat(F.lit(f"{n}="), F.coalesce(texts[n], F.lit("-"))) for n in sorted(texts)]), 256)


def nested_counts(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Counts by outer and inner key with subtotals and the grand total; ``ALL`` marks a total."""
    rolled = df.select(F.col(outer).cast("string").alias("o"), F.col(inner).cast("string").alias("i")).cube("o", "i")
    return rolled.agg(F.count(F.lit(1)).alias("n"), F.grouping("o").alias("go"), F.grouping("i").alias("gi")).select(
        F.when(F.col("go") == 1, F.lit("ALL")).otherwise(F.col("o")).alias(outer),
        F.when(F.col("gi") == 1, F.lit("ALL")).otherwise(F.col("i")).alias(inner),
        "n",
    )


def position_ranges(df: DataFrame, array_col: str) -> DataFrame:
    """Smallest and largest value at each array position."""
    return df.select(F.posexplode(array_col).alias("pos", "v")).groupBy("pos").agg(
        F.min("v").alias("lo"), F.max("v").alias("hi")
    )


def distinct_elements(df: DataFrame, array_col: str, name: str = "element") -> DataFrame:
    return df.select(F.explode(array_col).alias(name)).distinct()


def set_mismatch(df: DataFrame, expected_col: str, observed_col: str) -> DataFrame:
    """Rows whose expected and observed sets differ."""
    norm = lambda c: F.array_sort(F.array_distinct(F.col(c)))
    return df.where(~norm(expected_col).eqNullSafe(norm(observed_col)))


def readiness(df: DataFrame, blocked: Mapping[str, Column], review: Mapping[str, Column]) -> DataFrame:
    """Decision ladder from one aggregate: any blocking reason, else any review reason, else ready.

    The conditions are aggregate expressions evaluated once over the whole table.
    """
    named = {**{f"__b{i}": c for i, c in enumerate(blocked.values())}, **{f"__r{i}": c for i, c in enumerate(review.values())}}
    facts = df.agg(*[c.alias(n) for n, c in named.items()])
    b = F.array_compact(F.array(*[F.when(F.col(f"__b{i}"), F.lit(n)) for i, n in enumerate(blocked)]))
    r = F.array_compact(F.array(*[F.when(F.col(f"__r{i}"), F.lit(n)) for i, n in enumerate(review)]))
    return facts.select(
        F.when(F.size(b) > 0, F.lit("BLOCKED")).when(F.size(r) > 0, F.lit("REVIEW_REQUIRED")).otherwise(F.lit("READY")).alias("decision"),
        F.array_join(b, ",").alias("blocked_reasons"),
        F.array_join(r, ",").alias("review_reasons"),
    )


def split_overlaps(df: DataFrame, unit_col: str, split_col: str) -> DataFrame:
    """Units shared by each pair of splits (only pairs that share any).

    The unit's set of splits is at most as large as the number of splits.
    """
    sets = df.select(unit_col, split_col).distinct().groupBy(unit_col).agg(F.sort_array(F.collect_set(split_col)).alias("s"))
    several = sets.where(F.size("s") > 1)
    left = several.select("s", F.posexplode("s").alias("i", "split_a"))
    return (
        left.select("split_a", F.explode(F.expr("slice(s, i + 2, size(s))")).alias("split_b"))
        .groupBy("split_a", "split_b")
        .agg(F.count(F.lit(1)).alias("n_shared"))
    )


def overlap_matrix(df: DataFrame, unit_col: str, split_col: str, splits: Sequence[str]) -> DataFrame:
    """Every unordered pair of the named splits with its number of shared units, zeros included."""
    ordered = sorted(splits)
    pairs = [(a, b) for i, a in enumerate(ordered) for b in ordered[i + 1 :]]
    wanted = df.sparkSession.createDataFrame(pairs, "split_a string, split_b string")
    return wanted.join(split_overlaps(df, unit_col, split_col), ["split_a", "split_b"], "left").select(
        "split_a", "split_b", F.coalesce("n_shared", F.lit(0)).cast("bigint").alias("n_shared")
    )


def visibility(exported: DataFrame, manifest: DataFrame, key_col: str, category_col: str, forbidden: Sequence[str]) -> DataFrame:
    """Rows of forbidden categories that reached the export, per category."""
    keys = exported.select(key_col)
    return (
        manifest.where(F.col(category_col).isin(list(forbidden)))
        .join(keys, key_col, "left_semi")
        .groupBy(category_col)
        .agg(F.count(F.lit(1)).alias("n_visible"))
    )


def key_reconcile(expected: DataFrame, observed: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Keys on one side only, tagged ``missing`` or ``unexpected``; a key with a null is on its own side only.

    Both sides meet in one aggregate, so each key travels once and is held once.
    """
    keys = list(key_cols)
    both = expected.select(*keys, F.lit(1).alias("__side")).union(observed.select(*keys, F.lit(2).alias("__side")))
    sides = both.groupBy(*keys).agg(F.bit_or("__side").alias("__sides"))
    unknown = reduce(Column.__or__, (F.col(k).isNull() for k in keys))
    e, o = F.when(F.col("__sides") != 2, F.lit("missing")), F.when(F.col("__sides") != 1, F.lit("unexpected"))
    found = F.when(F.col("__sides") < 3, F.array(F.coalesce(e, o))).when(unknown, F.array(e, o))
    return sides.where((F.col("__sides") < 3) | unknown).select(*keys, F.explode(found).alias("status"))


def set_hashes(df: DataFrame, group_cols: Sequence[str], id_col: str) -> DataFrame:
    """Order-independent digest of the ids of every group, with their number."""
    return df.groupBy(*group_cols).agg(F.count(id_col).alias("n"), set_digest(id_col).alias("digest"))


def content_hash(df: DataFrame, volatile: Sequence[str] = ()) -> DataFrame:
    """Digest of all rows of a table regardless of order; volatile columns are left out."""
    columns = [c for c in df.columns if c not in set(volatile)]
    return df.select(row_digest(columns).alias("row")).agg(
        F.count("row").alias("n_rows"), set_digest("row").alias("digest")
    )


def same_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: schemas equal, rows missing, rows extra, identical."""
    same_schema = left.dtypes == right.dtypes
    if not same_schema:
        return left.sparkSession.createDataFrame(
            [(False, None, None, False)], "same_schema boolean, n_missing bigint, n_extra bigint, identical boolean"
        )
    columns = left.columns
    signed = left.withColumn("__s", F.lit(1)).unionByName(right.withColumn("__s", F.lit(-1)))
    net = signed.groupBy(*columns).agg(F.sum("__s").alias("net"))
    return net.agg(
        F.lit(True).alias("same_schema"),
        F.coalesce(F.sum(F.greatest("net", F.lit(0))), F.lit(0)).alias("n_missing"),
        F.coalesce(F.sum(F.greatest(-F.col("net"), F.lit(0))), F.lit(0)).alias("n_extra"),
        (F.count_if(F.col("net") != 0) == 0).alias("identical"),
    )


def snapshot_changes(before: DataFrame, after: DataFrame, key_col: str, value_cols: Sequence[str]) -> DataFrame:
    """Entries added, removed or changed between two inventories."""
    b = before.select(key_col, F.struct(*value_cols).alias("b"))
    a = after.select(key_col, F.struct(*value_cols).alias("a"))
    status = (
        F.when(F.col("b").isNull(), F.lit("added"))
        .when(F.col("a").isNull(), F.lit("removed"))
        .when(~F.col("a").eqNullSafe(F.col("b")), F.lit("changed"))
    )
    return b.join(a, key_col, "full_outer").select(key_col, status.alias("status")).where("status is not null")


def fold_manifest(assignments: DataFrame, key_col: str, fold_col: str, n_folds: int) -> DataFrame:
    """Long form ``(fold, part, key)``: a key is ``val`` in its own fold and ``train`` in every other."""
    folds = F.explode(F.sequence(F.lit(0), F.lit(n_folds - 1)))
    return assignments.select(key_col, F.col(fold_col).alias("__own"), folds.alias("fold")).select(
        "fold", F.when(F.col("fold") == F.col("__own"), F.lit("val")).otherwise(F.lit("train")).alias("part"), key_col
    )


def eligibility(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Boolean column per condition, ``eligible`` when all hold, and the first condition that fails."""
    checked = df.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()})
    eligible, first = F.lit(True), F.lit(None).cast("string")
    for name in reversed(list(conditions)):
        eligible = eligible & F.col(name)
        first = F.when(~F.col(name), F.lit(name)).otherwise(first)
    return checked.withColumns({"eligible": eligible, "first_failure": first})


def ordered_by_category(df: DataFrame, category_col: str, order: Sequence[str], then: Sequence[str]) -> DataFrame:
    """Sort by a custom category order, then by further keys; unknown categories come last."""
    lookup = F.create_map(*chain.from_iterable((F.lit(v), F.lit(i)) for i, v in enumerate(order)))
    place = F.coalesce(F.try_element_at(lookup, F.col(category_col)), F.lit(len(order)))
    return df.orderBy(place, *then)


def probability_quality(elements: DataFrame, probabilities: str, label: str, role: str, case: str) -> DataFrame:
    """Per role: extremes, largest deviation of the sum from one, cases, elements, labels seen."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, v: a + v)
    per_case = elements.groupBy(role, case).agg(
        F.min(F.array_min(probabilities)).alias("p_min"),
        F.max(F.array_max(probabilities)).alias("p_max"),
        F.max(F.abs(total - 1.0)).alias("sum_error"),
        F.count(F.lit(1)).alias("n"),
        F.sort_array(F.collect_set(label)).alias("labels"),
    )
    return per_case.groupBy(role).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum("n").alias("n_elements"),
        F.min("p_min").alias("p_min"),
        F.max("p_max").alias("p_max"),
        F.max("sum_error").alias("sum_error"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("labels")))), ",").alias("labels"),
    )


def remap_labels(label: Column, mapping: Mapping[int, int]) -> Column:
    """Total label map; a label outside the map becomes null, which callers report as a violation."""
    lookup = F.create_map(*chain.from_iterable((F.lit(int(k)), F.lit(int(v))) for k, v in mapping.items()))
    return F.try_element_at(lookup, label.cast("int"))


def linear_rescale(elements: DataFrame, params: DataFrame, case_col: str, value_col: str) -> DataFrame:
    """``value * slope + intercept`` with the parameters of each case; a zero or non-finite slope gives null."""
    joined = elements.join(measured_broadcast(params), case_col)
    ok = (F.col("slope") != 0) & ~F.isnan("slope") & (F.abs("slope") != float("inf")) & ~F.isnan("intercept")
    return joined.withColumn("rescaled", F.when(ok, F.col(value_col) * F.col("slope") + F.col("intercept")))


def frame_availability(headers: DataFrame, frame_counts: DataFrame, case_col: str, phases: Mapping[str, str], n_frames_col: str) -> DataFrame:
    """Whether each phase frame lies inside the series and has labelled elements.

    ``frame_counts`` is ``(case, frame, n_labelled)``; one join per phase on (case, frame).
    """
    out = headers
    for phase, frame_col in phases.items():
        counts = frame_counts.select(
            case_col, F.col("frame").alias(frame_col), F.col("n_labelled").alias(f"__{phase}")
        )
        out = (
            out.join(counts, [case_col, frame_col], "left")
            .withColumn(
                f"{phase}_available",
                (F.col(frame_col) >= 0) & (F.col(frame_col) < F.col(n_frames_col)) & (F.coalesce(F.col(f"__{phase}"), F.lit(0)) > 0),
            )
            .drop(f"__{phase}")
        )
    return out


def export_cohort(split: DataFrame, audit: DataFrame, key_col: str, roles: Sequence[str], audited: Column) -> DataFrame:
    """Split rows of the wanted roles joined to their audited entry; unaudited units drop out."""
    return split.where(F.col("role").isin(list(roles))).join(audit.where(audited), key_col)


def label_map_violations(observed: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Compare a ``(name, label)`` table with the required map: absent, unexpected or different labels."""
    wanted = observed.sparkSession.createDataFrame(list(expected.items()), "name string, expected_label bigint")
    joined = observed.select("name", F.col("label").cast("bigint").alias("label")).join(wanted, "name", "full_outer")
    problem = (
        F.when(F.col("label").isNull(), F.lit("absent"))
        .when(F.col("expected_label").isNull(), F.lit("unexpected"))
        .when(F.col("label") != F.col("expected_label"), F.lit("different label"))
    )
    return joined.select(*violation("label_map", F.col("name"), problem)).where("detail is not null")


def split_report(manifest: DataFrame, unit_col: str, split_col: str, group_col: str) -> DataFrame:
    """One row: units, splits, groups, units in several splits, id digest and content digest as a JSON record."""
    ids = manifest.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(split_col).alias("n_splits"),
        F.count_distinct(group_col).alias("n_groups"),
        set_digest(unit_col).alias("id_digest"),
    )
    shared = split_overlaps(manifest, unit_col, split_col).agg(F.coalesce(F.sum("n_shared"), F.lit(0)).alias("n_overlaps"))
    content = content_hash(manifest).select(F.col("digest").alias("content_digest"))
    one_row = ids.join(F.broadcast(shared)).join(F.broadcast(content))
    return one_row.withColumn("report", F.to_json(F.struct(*one_row.columns)))


def spacing_summary(df: DataFrame, spacing_col: str) -> DataFrame:
    """One row: medians per axis, in-plane mean and anisotropy ratio with their ranges.

    The spacing array is (x, y, z); in-plane is the mean of x and y, the ratio is z over in-plane.
    """
    s = F.col(spacing_col)
    parts = df.select(
        s[0].alias("x"), s[1].alias("y"), s[2].alias("z"), ((s[0] + s[1]) / 2.0).alias("in_plane")
    ).withColumn("ratio", F.try_divide(F.col("z"), F.col("in_plane")))
    ranges = parts.agg(
        F.count(F.lit(1)).alias("n_cases"),
        *[fn(c).alias(f"{tag}_{c}") for c in ("in_plane", "z", "ratio") for tag, fn in (("min", F.min), ("max", F.max))],
    )
    return ranges.join(F.broadcast(medians(parts, [], ["x", "y", "z", "in_plane", "ratio"])))


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """One-based place of every row of a globally sorted table.

    The sorted table is pinned first; each place is the place in its partition plus
    the rows of the partitions before it.
    """
    pinned = cut_lineage(ordered.withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()))
    counts = pinned.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy("__row"))
    return pinned.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + inside).drop("__part", "__row", "__before")
