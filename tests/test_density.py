"""Cluster numbers against a plain density clustering."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dqflow.operators import graph
from dqflow.operators import multivariate as M


def plain_clusters(z, weights, eps=0.5, least=5):
    """Label of the core points' component, -1 where a point has no core neighbour; and the labels a border point may take."""
    near = ((z[:, None, :] - z[None, :, :]) ** 2).sum(axis=2) <= eps * eps
    core = (near * weights).sum(axis=1) >= least
    label = np.full(len(z), -1)
    for i in np.flatnonzero(core):
        if label[i] < 0:
            todo = [i]
            while todo:
                j = todo.pop()
                if label[j] < 0:
                    label[j] = i
                    todo += [k for k in np.flatnonzero(near[j] & core) if label[k] < 0]
    return core, label, [set(label[near[i] & core]) for i in range(len(z))]


@pytest.mark.parametrize("dims,seed,parts", [(1, 1, 5), (2, 2, 9), (2, 3, 30), (3, 4, 12), (3, 5, 40)])
def test_clusters(spark, dims, seed, parts):
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 3, (parts, dims))
    rows = np.concatenate([middles[rng.integers(0, parts, 350)] + rng.normal(0, 0.25, (350, dims)), rng.normal(0, 4, (120, dims))]).round(2)
    rows = np.concatenate([rows, np.repeat(rows[:1], 7, axis=0)])
    names = [f"f{i}" for i in range(dims)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows] + [(None,) * dims], ", ".join(f"{n} double" for n in names))
    got = M.density_clusters(df, names).toPandas()
    z, weights = got[[f"x{i}" for i in range(dims)]].to_numpy(), got["w"].to_numpy()
    assert weights.sum() == len(rows)
    core, label, allowed = plain_clusters(z, weights)
    assert (got["core"].to_numpy() == core).all()
    names_of = {}
    for mine, want, options, is_core in zip(got["cluster"], label, allowed, core):
        if is_core:
            assert names_of.setdefault(want, mine) == mine
    assert len(set(names_of.values())) == len(names_of) >= (1 if dims == 1 else 2)
    for mine, options, is_core in zip(got["cluster"], allowed, core):
        if not is_core:
            assert (not options and np.isnan(mine)) or mine in {names_of[o] for o in options}
    noise = M.noise_summary(df, names).first()["anomaly_count"]
    assert noise == weights[got["cluster"].isna().to_numpy()].sum()


def test_components_of_paths_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (102, 100)] + [(200, 200)]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_points_of_one_component_do_not_meet(spark, monkeypatch):
    """A connected mass is settled by boxes: no pair of its points is left, however dense it is."""
    rng = np.random.default_rng(6)
    rows = [tuple(map(float, r)) for r in rng.uniform(0, 1, (4000, 2))]
    left, stored = [], M.stored_layer

    def counting(df, name):
        out = stored(df, name)
        left.extend([out.count()] if name == "density-open" else [])
        return out

    monkeypatch.setattr(M, "stored_layer", counting)
    got = M.density_clusters(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    assert got.agg(F.count_distinct("cluster")).first()[0] == 1
    assert left == [0]


def test_near_masses_stay_apart_and_touching_ones_join(spark):
    """Two dense lines a distance of 2 apart (standardised): boxes of every level leave pairs open, the points decide."""
    df = spark.createDataFrame([(x, y / 400) for x in (0.0, 1.0) for y in range(400)], "a double, b double")
    for eps, clusters in ((2 / 1.01, 2), (2 / 0.99, 1)):
        got = M.density_clusters(df, ["a", "b"], eps=eps)
        assert got.agg(F.count_distinct("cluster")).first()[0] == clusters
