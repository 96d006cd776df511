"""A tree's sample is uniform over rows, also where many rows are equal."""

import random

import numpy as np

from remitspark.operators import forest


def test_common_row_scores_as_by_uniform_samples(spark):
    rng = random.Random(6)
    rows = [(i, 8.0, 8.0) if i % 3 == 0 else (i, rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    common = df.where("id = 0")
    got = forest.score(common, forest.fit(df, ["x", "y"], 60, row_id="id"), ["x", "y"]).first().model_score
    trees = [forest.grow(np.array([r[1:] for r in rng.sample(rows, 256)]), np.random.default_rng(k)) for k in range(60)]
    uniform = spark.createDataFrame([(k, [[float(x) for x in node] for node in t]) for k, t in enumerate(trees)], "tree int, nodes array<array<double>>")
    assert abs(got - forest.score(common, uniform, ["x", "y"]).first().model_score) < 0.05


def test_registered_trees():
    import inspect

    from remitspark.plans import models

    assert inspect.signature(forest.fit).parameters["trees"].default == 200
    assert not any(f", {n})" in inspect.getsource(q) for q in (models.ml_02, models.ml_03, models.udf_02) for n in (30, 50))


def test_scores_of_a_fixed_forest(spark):
    """Scores by hand: mean depth of the leaves over the average path of 256 rows, missing features as 0."""
    trees = [(0, [[0.0, 5.0, 1.0, 2.0, 0.0], [-1.0, 0.0, 0.0, 0.0, 1.0], [1.0, 2.0, 3.0, 4.0, 0.0], [-1.0, 0.0, 0.0, 0.0, 2.0], [-1.0, 0.0, 0.0, 0.0, 4.5]]), (1, [[-1.0, 0.0, 0.0, 0.0, 3.0]])]
    model = spark.createDataFrame(trees, "tree int, nodes array<array<double>>")
    rows = [(1, 4.9, 9.0, 1.0), (2, 5.0, 1.9, 2.0), (3, 7.0, 2.0, 4.5), (4, None, None, 1.0)]
    got = {r.id: r.model_score for r in forest.score(spark.createDataFrame([r[:3] for r in rows], "id long, x double, y double"), model, ["x", "y"]).collect()}
    path = 2 * (np.log(255) + 0.5772156649015329) - 2 * 255 / 256
    assert all(abs(got[i] - 2 ** (-((depth + 3) / 2) / path)) < 1e-12 for i, _, _, depth in rows)


def test_samples_come_from_a_bounded_pool(spark, monkeypatch):
    """However many trees, the table is met once: what is dealt to trees is the pool."""
    monkeypatch.setattr(forest, "POOL", 500)
    df = spark.range(20_000).selectExpr("id", "cast(id % 97 as double) as x", "cast(id % 89 as double) as y")
    model = forest.fit(df, ["x", "y"], 40, row_id="id")
    assert model.count() == 40
    plan = model._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("GlobalLimit")
