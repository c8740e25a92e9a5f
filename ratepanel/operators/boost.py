"""Second-order boosting of squared errors over histograms.

Features are cut at mergeable quantiles once. A round grows one tree: for every level one
aggregate of gradients and Hessians by (node, feature, bin), partly added in the tasks,
and the best cut of every node found by Spark from running sums over the bins, so the driver sees one
row a node. Gains and leaf values carry L1 and L2 penalties. Three shapes:

* ``depth``: every node is cut as long as that gains;
* ``leaves``: nodes are cut best first up to a number of leaves. All nodes down to ``depth`` are
  evaluated, a level at a time, so the order of cuts is that of growing them one by one;
* ``symmetric``: one cut for all nodes of a level, the one with the largest gain in total.

Gradients are summed as integers (steps of a power of two, far below the spread of the
target), so a model does not depend on how rows fell into partitions. Rows for a
tree are drawn by a hash of their values and the seed, columns by the seed.
"""

from __future__ import annotations

import heapq
import json
import math
import random
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratepanel.session import settle

SHAPES = ("depth", "leaves", "symmetric")
# Steps of the integer gradients in the largest absolute target or prediction.
STEPS = 2**26
# Predictions are written every so many rounds; in between rows run through the trees since.
EVERY = 10
ARRAYS = ("feature", "cut", "left", "right", "value", "cover", "gain")


@dataclass(frozen=True)
class Settings:
    rounds: int = 800
    rate: float = 0.05
    depth: int = 7
    shape: str = "depth"
    leaves: int = 0
    l1: float = 0.0
    l2: float = 1.0
    min_rows: float = 1.0
    row_share: float = 1.0
    column_share: float = 1.0
    bins: int = 64
    seed: int = 42


# Training presets. Depth bounds the nodes looked at where leaves are counted.
BOOSTED: dict[str, Settings] = {
    "a": Settings(depth=7, l1=0.1, l2=1.0, min_rows=3, row_share=0.8, column_share=0.8),
    "b": Settings(depth=8, shape="leaves", leaves=63, l1=0.1, l2=1.0, min_rows=20, row_share=0.8, column_share=0.8),
    "c": Settings(depth=7, shape="symmetric", l2=3.0),
}


def boosted(name: str, **overrides: Any) -> Settings:
    """Settings of a preset by name."""
    if name not in BOOSTED:
        raise ValueError(f"unknown preset {name!r}, expected one of {', '.join(BOOSTED)}")
    return replace(BOOSTED[name], **overrides)


@dataclass
class Tree:
    """Nodes as columns; ``feature`` is -1 at a leaf, rows with ``x <= cut`` go left. ``cover`` counts rows."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    cover: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self, value: float, cover: float) -> int:
        for name, x in zip(ARRAYS, (-1, 0.0, -1, -1, value, cover, 0.0)):
            getattr(self, name).append(x)
        return len(self.feature) - 1

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x``."""
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(feature[at] >= 0)).size:
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= cut[node], left[node], right[node])
        return at

    def outputs(self, x: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf_of(x)]


@dataclass
class Boosted:
    """A constant and trees whose outputs are added to it."""

    base: float
    trees: list[Tree]
    settings: Settings = field(default_factory=Settings)

    def predict(self, df: DataFrame, x: str = "x", out: str = "pred") -> DataFrame:
        model = self

        @F.arrow_udf(T.DoubleType())
        def run(rows: pa.Array) -> pa.Array:
            return pa.array(model.base + sum((t.outputs(matrix(rows)) for t in model.trees), np.zeros(len(rows))))

        return df.withColumn(out, run(F.col(x)))

    def first(self, rounds: int) -> Boosted:
        """The model as it was after so many rounds."""
        return Boosted(self.base, self.trees[:rounds], self.settings)

    def to_json(self) -> str:
        return json.dumps({"base": self.base, "settings": asdict(self.settings), "trees": [asdict(t) for t in self.trees]})

    @staticmethod
    def from_json(text: str) -> Boosted:
        found = json.loads(text)
        return Boosted(found["base"], [Tree(**t) for t in found["trees"]], Settings(**found["settings"]))


def matrix(rows: pa.Array, kind: type = np.float64) -> np.ndarray:
    return rows.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(rows), -1)


# --- cuts -------------------------------------------------------------------


def quantile_cuts(df: DataFrame, width: int, bins: int, x: str = "x") -> list[list[float]]:
    """Ascending cuts of every feature, from mergeable quantile sketches."""
    shares = [i / bins for i in range(1, bins)]
    sketches = [F.percentile_approx(F.col(x)[i], shares, 100 * bins).alias(f"_{i}") for i in range(width)]
    found = df.agg(*sketches).first()
    return [sorted(set(c or [])) for c in found]


def binned(df: DataFrame, cuts: Sequence[Sequence[float]], x: str = "x", y: str = "target") -> DataFrame:
    """``bins, y, _draw``: the number of cuts below each feature, the target, a hash to draw rows by."""
    edges = [np.array(c, dtype=np.float64) for c in cuts]

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(rows: pa.Array) -> pa.Array:
        values = matrix(rows)
        found = np.stack([np.searchsorted(e, values[:, i], side="left") for i, e in enumerate(edges)], axis=1)
        return pa.ListArray.from_arrays(np.arange(0, found.size + 1, len(edges), dtype=np.int32), found.astype(np.int32).ravel())

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.select(run(F.col(x)).alias("bins"), F.col(y).cast("double").alias("y"), F.xxhash64(x, y).alias("_draw"))


def _step(most: float) -> float:
    """Integer steps in one unit: a power of two, so that a gradient is rounded once and alike everywhere."""
    return 2.0 ** (math.frexp(STEPS / most)[1] - 1) if most else 1.0


# --- one tree ---------------------------------------------------------------


def shrunk(g: Column, l1: float) -> Column:
    """The gradient after the L1 penalty."""
    return F.signum(g) * F.greatest(F.abs(g) - F.lit(l1), F.lit(0.0))


def score(g: Column, h: Column, s: Settings) -> Column:
    return shrunk(g, s.l1) * shrunk(g, s.l1) / (h + F.lit(s.l2))


def leaf_value(g: float, h: float, s: Settings) -> float:
    return -math.copysign(max(abs(g) - s.l1, 0.0), g) / (h + s.l2) * s.rate if h + s.l2 else 0.0


def drawn(draw: np.ndarray, s: Settings, number: int) -> np.ndarray:
    if s.row_share >= 1:
        return np.ones(len(draw), dtype=bool)
    x = draw.view(np.uint64) ^ np.uint64((s.seed * 0x9E3779B97F4A7C15 + (number + 1) * 0xBF58476D1CE4E5B9) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)) < np.uint64(int(s.row_share * 2**53))


def columns_of(width: int, s: Settings, number: int) -> list[int]:
    take = max(1, round(s.column_share * width))
    return sorted(random.Random(s.seed * 1_000_003 + number).sample(range(width), take))


def histogram(
    rows: DataFrame, since: list[Tree], tree: Tree, open_: list[int], s: Settings, number: int, step: float, most: int
) -> DataFrame:
    """``node, feature, bin, g, h``: integer gradients and counts of the open nodes, one row a task and place.

    ``since`` are trees whose outputs are not in ``pred`` yet; trees here cut bins, of which there
    are ``most``. A symmetric tree needs each cut in all nodes, so its empty bins have rows as well.
    """
    slot = np.full(len(tree.feature), -1)
    slot[open_] = np.arange(len(open_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: np.ndarray | None = None
        columns: list[int] = []
        for batch in batches:
            use = np.flatnonzero(drawn(batch.column("_draw").to_numpy(), s, number))
            if not len(use):
                continue
            x = matrix(batch.column("bins"), np.int64)[use]
            pred = batch.column("pred").to_numpy()[use] + sum((t.outputs(x) for t in since), np.zeros(len(use)))
            g = np.rint((pred - batch.column("y").to_numpy()[use]) * step).astype(np.int64)
            place = slot[tree.leaf_of(x)]
            x, g, place = x[place >= 0], g[place >= 0], place[place >= 0]
            if not len(x):
                continue
            columns = columns or columns_of(x.shape[1], s, number)
            if sums is None:
                sums = np.zeros((2, len(open_), len(columns), most), dtype=np.int64)
            for i, f in enumerate(columns):
                np.add.at(sums[0, :, i], (place, x[:, f]), g)
                np.add.at(sums[1, :, i], (place, x[:, f]), 1)
        if sums is not None:
            node, i, at = np.nonzero(sums[1] if s.shape != "symmetric" else np.ones(sums[1].shape))
            facts = [np.array(open_)[node], np.array(columns)[i], at, sums[0][node, i, at], sums[1][node, i, at]]
            yield pa.record_batch([pa.array(f.astype(np.int64)) for f in facts], ["node", "feature", "bin", "g", "h"])

    return rows.mapInArrow(run, "node long, feature long, bin long, g long, h long")


def cut_gains(parts: DataFrame, s: Settings, step: float) -> DataFrame:
    """``node, feature, bin, gain`` and the sums on both sides, for every cut that leaves rows on both."""
    rows = parts.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    side = Window.partitionBy("node", "feature")
    so_far = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left_g, left_h = F.sum("g").over(so_far), F.sum("h").over(so_far)
    rows = rows.select(
        "node",
        "feature",
        "bin",
        (left_g / F.lit(step)).alias("left_g"),
        left_h.cast("double").alias("left_h"),
        ((F.sum("g").over(side) - left_g) / F.lit(step)).alias("right_g"),
        (F.sum("h").over(side) - left_h).cast("double").alias("right_h"),
    )
    both = rows.where((F.col("left_h") >= max(s.min_rows, 1)) & (F.col("right_h") >= max(s.min_rows, 1)))
    whole = score(F.col("left_g") + F.col("right_g"), F.col("left_h") + F.col("right_h"), s)
    gain = score(F.col("left_g"), F.col("left_h"), s) + score(F.col("right_g"), F.col("right_h"), s) - whole
    return both.withColumn("gain", gain)


def best_cuts(gains: DataFrame, symmetric: bool) -> list[Any]:
    """The best cut of every node, ties to the smaller feature and bin; symmetric trees share one."""
    if symmetric:
        total = gains.groupBy("feature", "bin").agg(F.sum(F.round("gain", 9)).alias("total"))
        order = F.struct(-F.col("total"), "feature", "bin")
        best = total.where(F.col("total") > 0).agg(F.min_by(F.struct("feature", "bin"), order).alias("b")).select("b.feature", "b.bin")
        return gains.join(F.broadcast(best), ["feature", "bin"]).collect()
    order = F.struct(-F.col("gain"), "feature", "bin")
    found = gains.where(F.col("gain") > 0).groupBy("node").agg(F.min_by(F.struct(*gains.columns), order).alias("b"))
    return found.select("b.*").collect()


def best_first(tree: Tree, leaves: int) -> Tree:
    """The tree with only its ``leaves - 1`` cuts that a best-first growth makes."""
    kept: set[int] = set()
    heap = [(-tree.gain[0], 0)] if tree.feature[0] >= 0 else []
    while heap and len(kept) < leaves - 1:
        _, node = heapq.heappop(heap)
        kept.add(node)
        for child in (tree.left[node], tree.right[node]):
            if tree.feature[child] >= 0:
                heapq.heappush(heap, (-tree.gain[child], child))
    out = Tree()

    def copy(node: int) -> int:
        at = out.add(tree.value[node], tree.cover[node])
        if node in kept:
            out.feature[at], out.cut[at], out.gain[at] = tree.feature[node], tree.cut[node], tree.gain[node]
            out.left[at] = copy(tree.left[node])
            out.right[at] = copy(tree.right[node])
        return at

    copy(0)
    return out


def grow(rows: DataFrame, since: list[Tree], s: Settings, number: int, step: float, most: int) -> Tree:
    """One tree over bins; one aggregate a level."""
    tree = Tree()
    tree.add(0.0, 0.0)
    open_ = [0]
    for _ in range(s.depth):
        gains = cut_gains(histogram(rows, since, tree, open_, s, number, step, most), s, step)
        found = best_cuts(gains, s.shape == "symmetric")
        if not found:
            break
        # a node that the cut of a symmetric level leaves whole goes on to the next
        open_ = sorted(set(open_) - {r["node"] for r in found}) if s.shape == "symmetric" else []
        for r in sorted(found, key=lambda r: r["node"]):
            node = r["node"]
            tree.feature[node], tree.cut[node], tree.gain[node] = r["feature"], float(r["bin"]), r["gain"]
            tree.left[node] = tree.add(leaf_value(r["left_g"], r["left_h"], s), r["left_h"])
            tree.right[node] = tree.add(leaf_value(r["right_g"], r["right_h"], s), r["right_h"])
            if not tree.cover[node]:
                tree.cover[node] = r["left_h"] + r["right_h"]
            open_ += [tree.left[node], tree.right[node]]
    return best_first(tree, s.leaves) if s.shape == "leaves" else tree


def on_values(tree: Tree, cuts: Sequence[Sequence[float]]) -> Tree:
    """A tree that cuts bins, as one that cuts values."""
    out = Tree(**{name: list(getattr(tree, name)) for name in ARRAYS})
    out.cut = [cuts[f][int(b)] if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.cut)]
    return out


def advanced(rows: DataFrame, trees: list[Tree]) -> DataFrame:
    """Rows whose predictions hold the outputs of the trees as well."""

    @F.arrow_udf(T.DoubleType())
    def run(bins: pa.Array, pred: pa.Array) -> pa.Array:
        x = matrix(bins, np.int64)
        return pa.array(pred.to_numpy() + sum((t.outputs(x) for t in trees), np.zeros(len(x))))

    return rows.withColumn("pred", run("bins", "pred"))


def fit(df: DataFrame, settings: Settings, cuts: Sequence[Sequence[float]] | None = None, x: str = "x", y: str = "target") -> Boosted:
    """A model of ``y`` by the array ``x``; rows where either is null are left out."""
    if settings.shape not in SHAPES:
        raise ValueError(f"unknown shape {settings.shape!r}, expected one of {', '.join(SHAPES)}")
    head = df.where(F.col(x).isNotNull()).select(F.size(x).alias("n")).first()
    if head is None:
        raise ValueError("no rows to learn from")
    cuts = [list(c) for c in cuts] if cuts is not None else quantile_cuts(df, head["n"], settings.bins, x)
    rows = binned(df, cuts, x, y)
    base, most = rows.agg(F.avg("y"), F.max(F.abs("y"))).first()
    step = _step(most)
    base = round(base * step) / step
    return _continued(rows.withColumn("pred", F.lit(base)), Boosted(base, [], settings), cuts, step)


def _continued(rows: DataFrame, model: Boosted, cuts: Sequence[Sequence[float]], step: float) -> Boosted:
    """The model with the rounds it lacks; ``pred`` of the rows holds those it has."""
    most = max(len(c) for c in cuts) + 1
    trees, since = list(model.trees), []
    rows = settle(rows)
    for number in range(len(trees), model.settings.rounds):
        tree = grow(rows, since, model.settings, number, step, most)
        trees.append(on_values(tree, cuts))
        since.append(tree)
        if len(since) == EVERY and number + 1 < model.settings.rounds:
            rows, since = settle(advanced(rows, since)), []
    return Boosted(model.base, trees, model.settings)


# --- loss by round, early stop ----------------------------------------------


def staged_loss(df: DataFrame, model: Boosted, x: str = "x", y: str = "target") -> DataFrame:
    """``round, mse`` after every round from 0 on, in one pass: running sums of the trees' outputs, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(len(model.trees) + 1), 0
        for batch in batches:
            rows, target = matrix(batch.column("x")), batch.column("y").to_numpy()
            pred = np.full(len(target), model.base)
            sums[0] += ((pred - target) ** 2).sum()
            for i, tree in enumerate(model.trees):
                pred += tree.outputs(rows)
                sums[i + 1] += ((pred - target) ** 2).sum()
            n += len(target)
        if n:
            yield pa.record_batch([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.full(len(sums), n))], ["round", "sse", "n"])

    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).cast("double").alias("y"))
    parts = rows.mapInArrow(run, "round long, sse double, n long")
    return parts.groupBy("round").agg((F.sum("sse") / F.sum("n")).alias("mse"))


def early_stop(losses: DataFrame, patience: int = 50) -> DataFrame:
    """``best_round, mse, stopped_at``: the loss table read until ``patience`` rounds passed without a gain.

    The table has one row a round, so its window is as small as the model.
    """
    before = Window.orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    best = F.min("mse").over(before)
    marked = losses.select("round", "mse", (best.isNull() | (F.col("mse") < best)).alias("gains"))
    last = F.max(F.when(F.col("gains"), F.col("round"))).over(Window.orderBy("round"))
    waited = marked.withColumn("waited", F.col("round") - last)
    stop = waited.agg(F.coalesce(F.min(F.when(F.col("waited") >= patience, F.col("round"))), F.max("round")).alias("stopped_at"))
    seen = marked.join(F.broadcast(stop), F.col("round") <= F.col("stopped_at")).where("gains")
    return seen.groupBy("stopped_at").agg(F.max("round").alias("best_round"), F.max_by("mse", "round").alias("mse"))


def fit_until(
    df: DataFrame, settings: Settings, patience: int = 50, val_col: str = "is_val", ahead: int = 50, x: str = "x", y: str = "target"
) -> tuple[Boosted, DataFrame]:
    """A model cut back to its best round on the validation rows, and the loss table.

    Rounds are added ``ahead`` at a time until ``patience`` have passed without a gain.
    """
    fit_rows, watched = settle(df.where(~F.col(val_col))), settle(df.where(F.col(val_col)))
    cuts = quantile_cuts(fit_rows, len(fit_rows.select(x).first()[0]), settings.bins, x)
    rounds = 0
    model = Boosted(0.0, [], settings)
    while rounds < settings.rounds:
        rounds = min(settings.rounds, rounds + ahead)
        model = extend(fit_rows, model, replace(settings, rounds=rounds), cuts, x, y)
        losses = settle(staged_loss(watched, model, x, y))
        found = early_stop(losses, patience).first()
        if found["stopped_at"] - found["best_round"] >= patience:
            break
    return model.first(found["best_round"]), losses


def extend(df: DataFrame, model: Boosted, settings: Settings, cuts: Sequence[Sequence[float]], x: str = "x", y: str = "target") -> Boosted:
    """The model that ``fit`` gives with more rounds; the rounds there are stay."""
    if not model.trees:
        return fit(df, settings, cuts, x, y)
    on_bins = []
    for tree in model.trees:
        place = Tree(**{name: list(getattr(tree, name)) for name in ARRAYS})
        place.cut = [float(np.searchsorted(cuts[f], c)) if f >= 0 else 0.0 for f, c in zip(tree.feature, tree.cut)]
        on_bins.append(place)
    rows = binned(df, cuts, x, y)
    step = _step(rows.agg(F.max(F.abs("y"))).first()[0])
    rows = advanced(rows.withColumn("pred", F.lit(model.base)), on_bins)
    return _continued(rows, Boosted(model.base, model.trees, settings), cuts, step)


# --- contributions ----------------------------------------------------------


@dataclass(frozen=True)
class Path:
    """A leaf with, for each feature on its way, the interval (low, high] and the share of rows that pass its cuts."""

    value: float
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaf_paths(tree: Tree) -> list[Path]:
    out: list[Path] = []

    def walk(node: int, held: Mapping[int, tuple[float, float, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            features = tuple(sorted(held))
            low, high, share = zip(*[held[i] for i in features]) if features else ((), (), ())
            out.append(Path(tree.value[node], features, low, high, share))
            return
        low, high, share = held.get(f, (-math.inf, math.inf, 1.0))
        for child, bounds in ((tree.left[node], (low, min(high, tree.cut[node]))), (tree.right[node], (max(low, tree.cut[node]), high))):
            part = tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0
            walk(child, {**held, f: (*bounds, share * part)})

    walk(0, {})
    return out


def path_shares(path: Path, x: np.ndarray) -> np.ndarray:
    """Shapley values of a leaf's features for the rows of ``x``.

    A known feature passes or not, an unknown one passes with its share. The sum over all sets of the other
    features, by their number, is a product of polynomials, built one feature at a time.
    """
    d = len(path.features)
    passes = np.stack([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi in zip(path.features, path.low, path.high)], axis=1).astype(float)
    weight = [math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d) for k in range(d)]
    out = np.zeros((len(x), d))
    for i in range(d):
        poly = np.zeros((len(x), d))
        poly[:, 0] = 1.0
        for j in range(d):
            if j != i:
                known = np.concatenate([np.zeros((len(x), 1)), poly[:, :-1] * passes[:, j : j + 1]], axis=1)
                poly = poly * path.share[j] + known
        out[:, i] = path.value * (poly @ weight) * (passes[:, i] - path.share[i])
    return out


def expected(model: Boosted) -> float:
    """The prediction where no feature is known."""
    return model.base + sum(p.value * math.prod(p.share) for t in model.trees for p in leaf_paths(t))


def contributions(df: DataFrame, model: Boosted, x: str = "x", out: str = "contributions") -> DataFrame:
    """Adds the Shapley values of a row's features; with ``expected`` they add up to its prediction."""
    paths = [p for t in model.trees for p in leaf_paths(t) if p.features]

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def run(rows: pa.Array) -> pa.Array:
        values = matrix(rows)
        found = np.zeros_like(values)
        for path in paths:
            found[:, list(path.features)] += path_shares(path, values)
        offsets = np.arange(0, found.size + 1, max(1, found.shape[1]), dtype=np.int32)
        return pa.ListArray.from_arrays(offsets, found.ravel())

    return df.withColumn(out, run(F.col(x)))


def mean_contributions(df: DataFrame, names: Sequence[str], column: str = "contributions") -> DataFrame:
    """``feature, score``: the mean absolute contribution of every feature."""
    means = df.agg(*[F.avg(F.abs(F.col(column)[i])).alias(f"_{i}") for i in range(len(names))])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"_{i}").alias("score")) for i, c in enumerate(names)])
    return means.select(F.inline(each))
