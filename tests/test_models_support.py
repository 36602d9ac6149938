"""Ridge, shrinkage and nearest neighbours against numpy."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from driftgauge.operators import models, support
from driftgauge.operators.contracts import ContractError

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)) * [1.0, 5.0, 0.1] + [0.0, 100.0, 3.0]
    y = 0.5 + 0.1 * x[:, 0] - 0.02 * (x[:, 1] - 100) + 0.05 * rng.normal(size=120)
    rows = [(f"u{i:03d}", *map(float, r), float(t), "TRAIN" if i < 90 else "EVAL", "ID" if i < 110 else "OOD") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id string, a double, b double, c double, y double, split string, domain string").cache()


def ridge(x, y, alpha):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    z = (x - mean) / scale
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return lambda at: y.mean() + (at - mean) / scale @ beta


def test_ridge_grid_matches_closed_form(frame):
    from driftgauge.operators.resample import repeated_folds

    train = frame.where("split = 'TRAIN'")
    search = models.ridge_search(train, "id", NAMES, "y", alphas=(0.01, 1.0, 100.0))
    folds = {r["id"]: r["folds"][0] for r in repeated_folds(train.withColumn("g", F.lit(0)), ["g"], "id", [2026], 5).collect()}
    pdf = train.toPandas()
    fold = pdf["id"].map(folds).to_numpy()
    x, y = pdf[NAMES].to_numpy(), pdf["y"].to_numpy()
    for row in search.fold_scores.collect():
        own = fold == row["fold"]
        assert row["mae"] == pytest.approx(np.abs(ridge(x[~own], y[~own], row["alpha"])(x[own]) - y[own]).mean(), abs=1e-9)
    table = {r["alpha"]: r for r in models.cv_provenance(search.fold_scores).collect()}
    assert table[search.model.alpha]["rank"] == 1
    scored = train.select("id", search.model.score().alias("p")).toPandas().set_index("id")["p"]
    assert scored.loc[pdf["id"]].to_numpy() == pytest.approx(ridge(x, y, search.model.alpha)(x), abs=1e-9)


def test_baselines_use_the_training_split_only(frame):
    changed = frame.withColumn("y", F.when(F.col("split") == "EVAL", F.lit(9.0)).otherwise(F.col("y")))
    a, b = (models.ridge_search(f.where("split = 'TRAIN'"), "id", NAMES, "y", alphas=(1.0,)).model for f in (frame, changed))
    assert a.coefficient == pytest.approx(b.coefficient)
    assert models.train_mean(frame, F.col("split") == "TRAIN", "y") == pytest.approx(models.train_mean(changed, F.col("split") == "TRAIN", "y"))


def test_fit_refuses_mixed_populations(frame):
    with pytest.raises(ContractError, match="several populations"):
        models.fit_deployed(frame, "id", "domain", "ID", NAMES, "y")
    with pytest.raises(ContractError, match="wrong count"):
        models.fit_deployed(frame.where("domain = 'ID'"), "id", "domain", "ID", NAMES, "y", expected_n=3)


def test_forbidden_inputs_are_refused(frame):
    with pytest.raises(ValueError, match="forbidden"):
        models.fit_baselines(frame, "id", "split", "TRAIN", NAMES, "y", forbidden=["B"])


def test_ledoit_wolf_matches_the_published_formula(frame, spark):
    x = frame.select(*NAMES).toPandas().to_numpy()
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    n, p = x.shape
    s = x.T @ x / n
    mu = np.trace(s) / p
    delta = ((s - mu * np.eye(p)) ** 2).sum() / p
    beta = min(delta, sum(((np.outer(v, v) - s) ** 2).sum() for v in x) / n / n / p)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id int, vec array<double>")
    fitted = support.ledoit_wolf(df)
    assert fitted.shrinkage == pytest.approx(beta / delta)
    expected = np.linalg.inv((1 - beta / delta) * s + beta / delta * mu * np.eye(p))
    scores = support.mahalanobis(df, fitted, "id").toPandas().set_index("id")["support_mahalanobis"]
    assert scores.loc[range(n)].to_numpy() == pytest.approx(np.einsum("ij,jk,ik->i", x, expected, x))


@pytest.mark.parametrize("limit", [None, 0])
def test_nearest_distances_are_exact(spark, monkeypatch, limit):
    """A third of the reference is one repeated point, so one cell is hot and must be cut up."""
    monkeypatch.setattr(support, "REFERENCE_ROWS", 40)
    monkeypatch.setattr(support, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    r = rng.normal(size=(300, 4))
    r[::3] = r[0]
    q = np.vstack([rng.normal(size=(40, 4)), r[:3], r[0] + 1e-7])
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id int, vec array<double>")
    found = support.nearest_distances(frame(q), frame(r), "id", 120, broadcast_limit=limit).toPandas().set_index("id")["distances"]
    expected = np.sort(np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2)), axis=1)[:, :120]
    assert np.stack(found.loc[range(len(q))].to_numpy()) == pytest.approx(expected, abs=1e-12)
    with pytest.raises(ValueError):
        support.nearest_distances(frame(q), frame(r), "id", 301, broadcast_limit=limit)


def test_source_support_requires_the_source_domain(frame):
    with pytest.raises(ContractError, match="source_domain"):
        support.fit_source_support(frame, "split", "domain", ["TRAIN", "EVAL"], "ID", NAMES)
    fitted = support.fit_source_support(frame, "split", "domain", ["TRAIN"], "ID", NAMES)
    scores = support.support_scores(frame, fitted, "id", "split", "domain", ["EVAL"], (1, 3))
    assert scores.count() == 30
    assert support.score_violations(scores, "id", "split", ["EVAL"]).count() == 0


def test_few_cells_are_visited(spark):
    """Clustered rows in 15 dimensions: the search is exact and routes queries to a small share of the cells."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 15)) * 10
    ref = (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 15))).round(3)
    ask = (centres[rng.integers(0, 40, 200)] + rng.normal(size=(200, 15))).round(3)
    frame = lambda m: spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(m)], "id string, vec array<double>")
    got = {r["id"]: r["distances"] for r in support.nearest_distances(frame(ask), frame(ref), "id", 7, broadcast_limit=0).collect()}
    want = np.sort(np.sqrt(((ask[:, None] - ref[None]) ** 2).sum(axis=2)), axis=1)[:, :7]
    assert all(got[str(i)] == pytest.approx(list(want[i])) for i in range(200))
    directory = support.CellDirectory(frame(ref), "id", "vec", 3000)
    known = frame(ask).withColumn("known", F.element_at(F.array(*[F.lit(float(d)) for d in want[:, -1]]), F.col("id").cast("int") + 1))
    visited = support.routed_queries(known, directory, "id", "vec", False).count()
    assert visited < 0.2 * 200 * len(directory.cell)


def test_boxes_rule_out_cells_without_clusters(spark):
    """Features that hang together, in 15 dimensions and without clusters: a query meets a small share of the reference."""
    rng = np.random.default_rng(6)
    mix = rng.normal(size=(15, 15)) * (0.7 ** np.arange(15))
    ref, ask = rng.normal(size=(20_000, 15)) @ mix.T, rng.normal(size=(60, 15)) @ mix.T
    frame = lambda m: spark.createDataFrame([(str(i), [float(x) for x in v]) for i, v in enumerate(m)], "id string, vec array<double>")
    kth = np.sort(np.sqrt(((ask[:, None] - ref[None]) ** 2).sum(axis=2)), axis=1)[:, 9]
    directory = support.CellDirectory(frame(ref), "id", "vec", len(ref))
    rows = dict(zip(directory.cell.tolist(), directory.n.tolist()))
    known = spark.createDataFrame([(str(i), [float(x) for x in v], float(d)) for i, (v, d) in enumerate(zip(ask, kth))], "id string, vec array<double>, known double")
    met = sum(rows[r["cell"]] for r in support.routed_queries(known, directory, "id", "vec", False).collect())
    assert met < 0.2 * 60 * len(ref), met / 60 / len(ref)


def test_rounds_of_packs_are_exact(spark, monkeypatch):
    """Many packs in several rounds; a hot point, values far from zero and beyond single precision, a query that is not a number."""
    monkeypatch.setattr(support, "ROUND_LIMITS", 1)
    spark.conf.set("driftgauge.broadcast.bytes", "16384")
    rng = np.random.default_rng(8)
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id int, vec array<double>")
    try:
        for scale, shift in ((1.0, 1e6), (1e25, 0.0)):
            r = rng.normal(size=(900, 6)) * scale + shift
            r[::4] = r[0]
            q = np.vstack([rng.normal(size=(50, 6)) * scale + shift, r[:2], np.full((1, 6), np.nan)])
            found = support.nearest_distances(frame(q), frame(r), "id", 12, broadcast_limit=0).toPandas().set_index("id")["distances"].sort_index()
            assert list(found.index) == list(range(53)) and np.isnan(found[52]).all()
            want = np.sort(np.sqrt(((q[:52, None] - r[None]) ** 2).sum(axis=2)), axis=1)[:, :12]
            assert np.stack(found[:52].to_numpy()) == pytest.approx(want, rel=1e-9, abs=1e-9)
    finally:
        spark.conf.unset("driftgauge.broadcast.bytes")


def test_queries_without_clusters_are_sent_once(spark, monkeypatch):
    """In 64 dimensions no cell is ruled out; a query must still not travel once for every cell."""
    rng = np.random.default_rng(9)
    r, q = rng.normal(size=(600, 64)), rng.normal(size=(40, 64))
    frame = lambda m: spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(m)], "id int, vec array<double>")
    sent, routed = [], support.routed_queries

    def counted(*args):
        out = routed(*args)
        sent.append(out.count())
        return out

    monkeypatch.setattr(support, "routed_queries", counted)
    found = support.nearest_distances(frame(q), frame(r), "id", 10, broadcast_limit=0).toPandas().set_index("id")["distances"]
    expected = np.sort(np.sqrt(((q[:, None] - r[None]) ** 2).sum(axis=2)), axis=1)[:, :10]
    assert np.stack(found.loc[range(40)].to_numpy()) == pytest.approx(expected, abs=1e-12)
    assert sum(sent) == 40
