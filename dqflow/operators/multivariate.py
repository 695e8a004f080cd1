"""Multivariate outliers: isolation forest and density noise, both distributed."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dqflow.operators.anomaly import MULTIVARIATE, anomaly_rows, banded
from dqflow.operators.quantiles import exact_percentiles
from dqflow.operators.skew import join_unique
from dqflow.sources.tables import stored_layer

#: Rows drawn per tree and number of trees, both parameters: the model is the subsample by definition of the method.
SAMPLE = 256
TREES = 100
#: Fewer complete rows give a status row instead of a finding.
MIN_ROWS = 100


def complete_points(df: DataFrame, fields, sums=()) -> DataFrame:
    """Distinct feature vectors without NULLs and how often each occurs, with the sums of the columns ``sums``.

    Everything below depends on a row through its vector only, so copies are
    folded first, map-side.
    """
    xs = [f"x{i}" for i in range(len(fields))]
    rows = df.select(*[F.col(f).cast("double").alias(x) for f, x in zip(fields, xs)], *sums).dropna(subset=xs)
    return rows.groupBy(*xs).agg(F.count(F.lit(1)).alias("w"), *[F.sum(c).alias(c) for c in sums])


# -- isolation forest ------------------------------------------------------

def forest_sample(points: DataFrame, dims: int, trees: int = TREES, size: int = SAMPLE, seed: int = 42) -> DataFrame:
    """Vectors with the tree that draws them and how often: about ``size`` rows for each of ``trees`` trees.

    Rows are drawn with replacement, so a vector with ``w`` rows is drawn ``w`` times as often as a single one.  A
    vector expects ``trees * size * w / rows`` draws; it gets the whole part and, by a hash of the vector, one more for
    the fraction.  Each draw is dealt to a tree by hash.  No sort and no limit: the total is the sum of
    the expectations, whatever the number of vectors, and does not depend on partitioning.
    """
    xs = [F.col(f"x{i}") for i in range(dims)]

    def uniform(salt):
        return (F.pmod(F.xxhash64(F.lit(salt), *xs), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)

    rows = points.agg(F.sum("w")).first()[0] or 1
    expected = F.col("w") * F.lit(float(min(size, rows) * trees)) / F.lit(float(rows))
    times = F.floor(expected) + F.when(uniform(seed) < expected - F.floor(expected), 1).otherwise(0)
    drawn = points.withColumn("_times", times.cast("int")).where("_times > 0")
    # A vector of many draws gives every tree its share and deals out the rest, one row per tree at most.
    shares = drawn.withColumn("_d", F.explode(F.sequence(F.lit(0), F.least(F.col("_times"), F.lit(trees)) - 1)))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), *xs), F.lit(trees))
    each = F.floor(F.col("_times") / trees) + F.when(F.col("_d") < F.col("_times") % trees, 1).otherwise(0)
    dealt = F.when(F.col("_times") < trees, F.pmod(F.xxhash64(F.lit(seed + 2), "_d", *xs), F.lit(trees))).otherwise(
        F.pmod(start + F.col("_d"), F.lit(trees)))
    return shares.select(
        *xs, dealt.cast("int").alias("tree"), F.when(F.col("_times") < trees, F.lit(1)).otherwise(each).cast("int").alias("n"))


NODE = "tree int, node int, feature int, cut double, size double"


def _grow(dims: int, limit: int, seed: int):
    cols = [f"x{i}" for i in range(dims)]

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng(seed + tree)
        pdf = pdf.sort_values([*cols, "n"])
        out, todo = [], [(1, pdf[cols].to_numpy(), pdf["n"].to_numpy())]
        while todo:
            node, rows, copies = todo.pop()
            count = float(copies.sum())
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if node >= 2**limit or len(spread) == 0:
                out.append((tree, node, -1, 0.0, count))
                continue
            f = int(spread[rng.integers(len(spread))])
            lo, hi = rows[:, f].min(), rows[:, f].max()
            cut = float(rng.uniform(lo, hi))
            left = rows[:, f] <= cut
            out.append((tree, node, f, cut, count))
            todo += [(2 * node, rows[left], copies[left]), (2 * node + 1, rows[~left], copies[~left])]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])

    return build


def _mean_path(n):
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 2)
    c = 2.0 * (np.log(big - 1) + 0.5772156649015329) - 2.0 * (big - 1) / big
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def grow_forest(points: DataFrame, dims: int, trees=TREES, size=SAMPLE, seed=42) -> DataFrame:
    """Node table of the forest; each tree is grown from its own small sample."""
    limit = int(math.ceil(math.log2(size)))
    sample = forest_sample(points, dims, trees, size, seed)
    return sample.groupBy("tree").applyInPandas(_grow(dims, limit, seed), NODE)


def _path_lengths(x, tree, limit: int):
    feature, cut, extra, _ = tree
    node, row = np.ones(len(x), dtype=np.int64), np.arange(len(x))
    for _ in range(limit):
        f = feature[node]
        step = 2 * node + (x[row, np.maximum(f, 0)] > cut[node])
        node = np.where(f >= 0, step, node)
    return np.floor(np.log2(node)) + extra[node]


#: Most boxes (of all trees together) that are worked out beforehand.
BOXES = 4_000_000


def _boxes(tables, dims: int, limit: int):
    """Path lengths by box: a tree's cuts divide the space into boxes that share a leaf, so a point needs its box only.

    Returns the sorted cuts of all trees per feature and, per tree, for each feature the tree's interval (times its
    stride) by place among all cuts, and the path length by box.  None if the boxes are too many, as for
    many features: then points walk down the trees.
    """
    own = [[np.unique(t[1][t[0] == d]) for d in range(dims)] for t in tables]
    if sum(math.prod(len(c) + 1 for c in cuts) for cuts in own) > BOXES:
        return None, None
    every = [np.unique(np.concatenate([cuts[d] for cuts in own])) if own else np.zeros(0) for d in range(dims)]
    boxes = []
    for tree, cuts in zip(tables, own):
        shape = [len(c) + 1 for c in cuts]
        # A cut is the last point of the interval before it.
        corners = np.meshgrid(*[np.append(c, np.inf) for c in cuts], indexing="ij")
        path = _path_lengths(np.column_stack([g.ravel() for g in corners]), tree, limit)
        steps = [np.append(0, np.searchsorted(c, e, side="right")) * math.prod(shape[d + 1:]) for d, (c, e) in enumerate(zip(cuts, every))]
        boxes.append(([s.astype(np.int32) for s in steps], path))
    return every, boxes


def score_points(points: DataFrame, dims: int, forest: DataFrame, size=SAMPLE) -> DataFrame:
    """Add ``score`` in (0, 1); the model is at most ``trees * 2 * size`` nodes."""
    limit = int(math.ceil(math.log2(size)))
    model = forest.toPandas()
    tables = []
    for _, nodes in sorted(model.groupby("tree"), key=lambda kv: kv[0]):
        feature = np.full(2 ** (limit + 1), -1)
        cut = np.zeros(2 ** (limit + 1))
        rows = np.zeros(2 ** (limit + 1))
        feature[nodes["node"]], cut[nodes["node"]], rows[nodes["node"]] = nodes["feature"], nodes["cut"], nodes["size"]
        tables.append((feature, cut, _mean_path(rows), float(rows[1])))
    # Trees of one row or none tell nothing: every score is then 0.5, never NULL.
    expected = max(float(np.mean([_mean_path(t[3]) for t in tables])) if tables else 0.0, 1e-9)
    cuts, boxes = _boxes(tables, dims, limit)

    @F.pandas_udf("double")
    def path_score(*cols: pd.Series) -> pd.Series:
        xs = [c.to_numpy(dtype=float) for c in cols]
        total = np.zeros(len(xs[0]))
        if boxes is not None:
            places = [np.searchsorted(c, x) for c, x in zip(cuts, xs)]
            for steps, path in boxes:
                at = steps[0].take(places[0])
                for s, p in zip(steps[1:], places[1:]):
                    at += s.take(p)
                total += path.take(at)
        else:
            x = np.column_stack(xs)
            for tree in tables:
                total += _path_lengths(x, tree, limit)
        if expected <= 1e-9:
            return pd.Series(np.full(len(x), 0.5))
        return pd.Series(np.exp2(-(total / len(tables)) / expected))

    return points.withColumn("score", path_score(*[f"x{i}" for i in range(dims)]))


def isolation_scores(df: DataFrame, fields, trees=TREES, size=SAMPLE, seed=42, sums=()) -> DataFrame:
    """Distinct vectors with their weight, the sums of the columns ``sums`` and isolation score.

    Splits are drawn between the sample's own extremes, so scaling a feature
    changes nothing and no standardisation pass is needed.
    """
    points = stored_layer(complete_points(df, fields, sums), "forest-points")  # read for the total, the draw and the scores
    return score_points(points, len(fields), grow_forest(points, len(fields), trees, size, seed), size)


def forest_summary(df: DataFrame, fields, contamination=0.1, **kw) -> DataFrame:
    """One row: records, records above the score threshold and the threshold."""
    scored = isolation_scores(df, fields, **kw).groupBy("score").agg(F.sum("w").alias("w"))
    scored = stored_layer(scored, "forest-scores")  # the model runs once, the threshold reads this
    # The upper of two ranks: no more than the contamination lies above it, at any number of rows.
    limit = exact_percentiles(scored, [], "score", {"_limit": 1 - contamination}, weight="w", interpolate=False).select("_limit")
    s = scored.withColumn("_limit", limit.scalar())
    out = F.col("score") > F.col("_limit")
    return s.agg(
        F.sum("w").alias("total_records"),
        F.coalesce(F.sum(F.when(out, F.col("w"))), F.lit(0)).alias("anomaly_count"),
        F.max("_limit").alias("threshold_score"),
        (F.sum(F.when(out, F.col("score") * F.col("w"))) / F.sum(F.when(out, F.col("w")))).alias("avg_anomaly_score"),
    )


def detector_status(totals: DataFrame, fields, min_rows: int = MIN_ROWS) -> DataFrame:
    """Which fields a detector used, on how many records, and whether they were enough."""
    n = F.coalesce(F.col("total_records"), F.lit(0))
    return totals.select(
        F.lit(",".join(fields)).alias("fields"), n.cast("bigint").alias("total_records"),
        F.when(n < min_rows, "too few rows").otherwise("examined").alias("status"))


def forest_anomalies(df: DataFrame, table: str, fields, contamination=0.1, min_rows=MIN_ROWS, **kw) -> DataFrame:
    rows = forest_summary(df, fields, contamination, **kw).where(
        (F.col("total_records") >= min_rows) & (F.col("anomaly_count") > 0)
    )
    pct = F.col("anomaly_count") / F.col("total_records") * 100
    return anomaly_rows(
        rows, table, MULTIVARIATE, "isolation_forest", F.lit(",".join(fields)), banded(pct, 15, 10, 5),
        F.least(F.lit(10.0), pct / 2), F.col("anomaly_count"), contamination,
        {
            "contamination": F.lit(contamination), "anomaly_count": F.col("anomaly_count"), "anomaly_percentage": pct,
            "total_records": F.col("total_records"), "avg_anomaly_score": F.col("avg_anomaly_score"),
        },
    )


# -- density noise ---------------------------------------------------------

def standardised(points: DataFrame, dims: int) -> DataFrame:
    """Zero mean, unit population deviation; a constant feature becomes zero."""
    w = F.col("w")
    stats = []
    for i in range(dims):
        x = F.col(f"x{i}")
        mean = F.sum(x * w) / F.sum(w)
        stats += [mean.alias(f"m{i}"), F.sqrt(F.greatest(F.sum(x * x * w) / F.sum(w) - mean * mean, F.lit(0.0))).alias(f"s{i}")]
    moments = points.agg(*stats).select(F.struct(*[c for i in range(dims) for c in (f"m{i}", f"s{i}")])).scalar()
    z = {
        f"x{i}": F.when(F.col("_m")[f"s{i}"] > 0, (F.col(f"x{i}") - F.col("_m")[f"m{i}"]) / F.col("_m")[f"s{i}"]).otherwise(F.lit(0.0))
        for i in range(dims)
    }
    out = points.withColumn("_m", moments).withColumns(z).drop("_m")
    return out.groupBy(*[f"x{i}" for i in range(dims)]).agg(F.sum("w").alias("w"))


def gap_within(a, b, eps: float, side: float):
    """Whether two cells (lists of coordinates) may hold points within ``eps``: the gap between the boxes, rounded in favour."""
    gaps = [F.greatest(F.abs(x - y) - 1, F.lit(0)) for x, y in zip(a, b)]
    return reduce(lambda p, q: p + q, [g * g for g in gaps]) * (side * side) <= eps * eps * (1 + 1e-9)


def occupied_neighbours(cells: DataFrame, names, reach: int, eps: float, side: float) -> DataFrame:
    """Pairs of distinct occupied cells (columns, and the other's with ``_``) that may hold points within ``eps``, each with itself too.

    Cells are looked up through blocks of ``reach`` cells a side, at least ``eps`` wide: only blocks are sent to their
    3^d neighbours, only occupied ones answer, and a block holds at most reach^d cells.
    """
    blocks = [f"g{i}" for i in range(len(names))]
    held = cells.select(*names).distinct().withColumns({g: F.floor(F.col(c) / reach).cast("long") for g, c in zip(blocks, names)})
    steps = F.array(*[F.struct(*[F.lit(o).cast("long").alias(f"o{i}") for i, o in enumerate(off)]) for off in itertools.product((-1, 0, 1), repeat=len(names))])
    found = held.select(*blocks).distinct()
    sent = found.select(*[F.col(g).alias(f"_{g}") for g in blocks], F.explode(steps).alias("o")).select(
        *[f"_{g}" for g in blocks], *[(F.col(f"_{g}") + F.col(f"o.o{i}")).alias(g) for i, g in enumerate(blocks)])
    near = sent.join(found, blocks, "left_semi")
    other = held.select(*[F.col(c).alias(f"_{c}") for c in names], *[F.col(g).alias(f"_{g}") for g in blocks])
    pairs = held.join(near, blocks).join(other, [f"_{g}" for g in blocks])
    return pairs.where(gap_within([F.col(c) for c in names], [F.col(f"_{c}") for c in names], eps, side)).select(*names, *[f"_{c}" for c in names])


class Density:
    """Standardised distinct points of a table in grid cells of diagonal ``eps``, and which of them are core points.

    All points of one cell are neighbours, so a cell holding ``min_samples`` rows makes all of them core points and no
    distance inside it is ever computed.  What remains are cells with fewer rows.  Their points are sent to the
    occupied cells around them, at most ``min_samples - 1`` from each, as one short array per cell; that array is
    looked up by every point of the cell, however many there are.
    """

    def __init__(self, df: DataFrame, fields, eps: float, min_samples: int):
        d = len(fields)
        self.eps, self.xs, self.cells = eps, [f"x{i}" for i in range(d)], [f"c{i}" for i in range(d)]
        self.side, self.reach = eps / math.sqrt(d), int(math.ceil(math.sqrt(d)))
        points = standardised(complete_points(df, fields), d).withColumns(
            {c: F.coalesce(F.floor(F.col(x) / self.side).cast("long"), F.lit(0).cast("long")) for c, x in zip(self.cells, self.xs)})
        sizes = points.groupBy(*self.cells).agg(F.sum("w").alias("rows"))
        sparse_cells = sizes.where(F.col("rows") < min_samples).select(*self.cells, F.lit(True).alias("sparse"))
        marked = join_unique(points, sparse_cells, self.cells).withColumn("sparse", F.coalesce("sparse", F.lit(False)))
        self.marked = stored_layer(marked, "density-points")  # read by every step below
        self.sparse = self.marked.where("sparse")
        self.neighbours = stored_layer(occupied_neighbours(self.marked, self.cells, self.reach, eps, self.side), "density-cells")
        pairs = join_unique(self.marked, self.around(self.sparse), self.cells, "inner").select(
            "w", "sparse", F.explode(F.filter("near", self.within)).alias("p"))
        counts = pairs.groupBy("p").agg(F.sum("w").alias("neighbours"), F.count_if(~F.col("sparse")).alias("dense_neighbours"))
        self.judged = self.sparse.withColumn("p", F.struct(*self.xs)).join(counts, "p").withColumn("core", F.col("neighbours") >= min_samples)

    def around(self, rows: DataFrame) -> DataFrame:
        """For every occupied cell the points of ``rows`` (few per cell) in the cells around it."""
        near = rows.select(F.struct(*self.xs).alias("p"), *self.cells).join(self.neighbours, self.cells)
        return near.groupBy(*[F.col(f"_{c}").alias(c) for c in self.cells]).agg(F.collect_list("p").alias("near"))

    def within(self, p):
        return reduce(lambda a, b: a + b, [(p[x] - F.col(x)) * (p[x] - F.col(x)) for x in self.xs]) <= self.eps * self.eps


def density_noise(df: DataFrame, fields, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Exact noise set: standardised vectors, weight and ``noise`` flag."""
    g = Density(df, fields, eps, min_samples)
    open_points = g.judged.where("NOT core AND dense_neighbours = 0")
    reached = (
        join_unique(g.judged.where("core").select(*g.xs, *g.cells), g.around(open_points), g.cells, "inner")
        .select(F.explode(F.filter("near", g.within)).alias("p"))
        .distinct()
        .withColumn("reached", F.lit(True))
    )
    noise = open_points.join(reached, "p", "left").where("reached IS NULL").select(*g.xs, F.lit(True).alias("noise"))
    return g.marked.where("NOT sparse").select(*g.xs, "w", F.lit(False).alias("noise")).unionByName(
        g.sparse.select(*g.xs, "w").join(noise, g.xs, "left").select(*g.xs, "w", F.coalesce("noise", F.lit(False)).alias("noise"))
    )


#: A box is cut into so many finer ones per side (a power of two, so that boxes nest exactly), at most so many times.
FINER, LEVELS = 4, 3


def cell_labels(core: DataFrame, g: Density) -> DataFrame:
    """node, label (the smallest number of its component) of the numbered core cells that are linked to others.

    Two cells are linked when they hold core points within ``eps`` of each other.  ``core`` has x0.., c0.. and ``cell``.
    Pairs of neighbouring cells are compared by their occupied boxes: boxes that lie within ``eps`` as a whole link
    them, boxes further apart are done with.  What then is open is looked at through finer boxes, and their points
    meet in the end, but only between cells that are not in one component yet: no other pair can change a label.
    """
    from dqflow.operators.graph import components

    ids = core.select(*g.cells, "cell").distinct()
    open_pairs = g.neighbours.join(ids.withColumnRenamed("cell", "a"), g.cells).join(
        ids.select(*[F.col(c).alias(f"_{c}") for c in g.cells], F.col("cell").alias("b")), [f"_{c}" for c in g.cells]).where("a < b").select("a", "b")
    linked, labels, held = None, None, []
    for level in range(1, LEVELS + 1):
        side = g.side / FINER**level
        boxes = [f"f{level}_{i}" for i in range(len(g.xs))]
        # The boxes of the level before, by which open pairs are known, and those within them.
        fine = core.select("cell", *[F.floor(F.col(x) / side).cast("long").alias(f) for f, x in zip(boxes, g.xs)]).distinct()
        fine = fine.withColumns({h: F.floor(F.col(f) / FINER).cast("long") for h, f in zip(held, boxes)})
        other = fine.select(F.col("cell").alias("b"), *[F.col(c).alias(f"_{c}") for c in [*held, *boxes]])
        met = open_pairs.join(fine.withColumnRenamed("cell", "a"), ["a", *held]).join(other, ["b", *[f"_{h}" for h in held]])
        far = [F.abs(F.col(f) - F.col(f"_{f}")) + 1 for f in boxes]
        whole = reduce(lambda p, q: p + q, [x * x for x in far]) * (side * side) <= g.eps * g.eps * (1 - 1e-9)
        near = gap_within([F.col(f) for f in boxes], [F.col(f"_{f}") for f in boxes], g.eps, side)
        met = stored_layer(met.where(near).select("a", "b", *boxes, *[f"_{f}" for f in boxes], whole.alias("whole")), "density-boxes")
        found = met.where("whole").select("a", "b").distinct()
        linked = found if linked is None else linked.unionByName(found)
        labels = stored_layer(components(linked), "density-labels")
        held = boxes
        open_pairs = stored_layer(apart(met.where("NOT whole").drop("whole"), labels), "density-open")
        if open_pairs.isEmpty():
            return labels
    mine = core.select(F.col("cell").alias("a"), *[F.floor(F.col(x) / side).cast("long").alias(f) for f, x in zip(held, g.xs)], *g.xs)
    theirs = mine.select(F.col("a").alias("b"), *[F.col(c).alias(f"_{c}") for c in [*held, *g.xs]])
    distance = reduce(lambda p, q: p + q, [(F.col(x) - F.col(f"_{x}")) * (F.col(x) - F.col(f"_{x}")) for x in g.xs])
    close = open_pairs.join(mine, ["a", *held]).join(theirs, ["b", *[f"_{h}" for h in held]]).where(distance <= g.eps * g.eps)
    return components(linked.unionByName(close.select("a", "b").distinct()))


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) of cells that are not in one component."""
    out = pairs
    for end in ("a", "b"):
        out = out.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_label_{end}")), end, "left")
    same = F.coalesce("_label_a", "a") == F.coalesce("_label_b", "b")
    return out.where(~same).select(*pairs.columns)


def density_clusters(df: DataFrame, fields, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Standardised vectors, weight, ``core`` flag and ``cluster`` (NULL for noise).

    Core points of one grid cell belong together, so clusters are the connected components of core cells.  Its
    number is the smallest cell number (a hash) of the component.  A point that is no core point belongs to the
    cluster of a core point within ``eps``, the smallest number if there are several.
    """
    g = Density(df, fields, eps, min_samples)
    judged = stored_layer(g.judged.select(*g.xs, *g.cells, "w", "core"), "density-judged")
    core = g.marked.where("NOT sparse").select(*g.xs, *g.cells, "w").unionByName(judged.where("core").drop("core"))
    core = stored_layer(core.withColumn("cell", F.xxhash64(*g.cells)), "density-core")
    labels = cell_labels(core, g).select(F.col("node").alias("cell"), "label")
    numbered = join_unique(core, labels, "cell").withColumn("cluster", F.coalesce("label", "cell"))
    border = judged.where("NOT core")
    reached = join_unique(numbered.select(*g.xs, *g.cells, "cluster"), g.around(border), g.cells, "inner").select(
        "cluster", F.explode(F.filter("near", g.within)).alias("p")).groupBy("p").agg(F.min("cluster").alias("cluster"))
    rest = border.withColumn("p", F.struct(*g.xs)).join(reached, "p", "left")
    return numbered.select(*g.xs, "w", F.lit(True).alias("core"), "cluster").unionByName(rest.select(*g.xs, "w", F.lit(False).alias("core"), "cluster"))


def noise_summary(df: DataFrame, fields, eps=0.5, min_samples=5) -> DataFrame:
    return density_noise(df, fields, eps, min_samples).agg(
        F.sum("w").alias("total_records"),
        F.coalesce(F.sum(F.when(F.col("noise"), F.col("w"))), F.lit(0)).alias("anomaly_count"),
    )


def dbscan_anomalies(df: DataFrame, table: str, fields, eps=0.5, min_samples=5, min_rows=MIN_ROWS) -> DataFrame:
    rows = noise_summary(df, fields, eps, min_samples).where(
        (F.col("total_records") >= min_rows) & (F.col("anomaly_count") > 0)
    )
    pct = F.col("anomaly_count") / F.col("total_records") * 100
    return anomaly_rows(
        rows, table, MULTIVARIATE, "dbscan", F.lit(",".join(fields)),
        F.when(pct > 5, F.lit("medium")).otherwise(F.lit("low")), F.least(F.lit(10.0), pct / 3), F.col("anomaly_count"), eps,
        {
            "eps": F.lit(eps), "min_samples": F.lit(min_samples), "anomaly_count": F.col("anomaly_count"),
            "anomaly_percentage": pct, "total_records": F.col("total_records"),
        },
    )
