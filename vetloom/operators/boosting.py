"""Gradient boosting of trees with L1 and L2 penalties, from histograms of gradients.

Values become bins once. Every level of a tree is one aggregate over the rows: gradient and curvature
summed per node, feature and bin, which combines map-side to at most nodes x features x bins rows. Gains
follow from running sums over the bins, and one row per node reaches the driver.
"""

from __future__ import annotations

import math
import random
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: Gradients are summed as integers, so that sums do not depend on the order of the rows.
UNIT = 1 << 20
#: Rounds after which the margins are written, so that neither plan nor lineage grows with the rounds.
WRITTEN = 10
#: Numbers that the bins of a feature may have, and the one that stands for no bin.
SPAN, NO_BIN = 1 << 33, -(1 << 31) - 1


@dataclass(frozen=True)
class Penalty:
    """What a leaf costs: ``l1`` takes from its gradient, ``l2`` adds to its curvature; no child below ``least``."""

    l1: float = 0.2
    l2: float = 0.2
    least: float = 1.0

    def score(self, g: str, h: str) -> str:
        """SQL text: what rows with gradient ``g`` and curvature ``h`` are worth as one leaf."""
        return f"pow(greatest(abs({g}) - {self.l1!r}D, 0D), 2) / ({h} + {self.l2!r}D)"

    def value(self, g: float, h: float) -> float:
        return -(1 if g > 0 else -1) * max(abs(g) - self.l1, 0.0) / (h + self.l2)


def split_gains(sums: DataFrame, penalty: Penalty = Penalty()) -> DataFrame:
    """``(node, feature, bin, gain)`` and the sums left and right of every possible split.

    ``sums`` holds ``g`` and ``h`` per ``(node, feature, bin)``. A split sends rows of its bin and the
    ones below to the left. The last bin of a feature splits nothing and has no row.
    """
    own = "(PARTITION BY node, feature)"
    upto = "(PARTITION BY node, feature ORDER BY bin)"
    rows = sums.selectExpr(
        "node", "feature", "bin", f"sum(g) OVER {upto} AS gl", f"sum(h) OVER {upto} AS hl",
        f"sum(g) OVER {own} AS ga", f"sum(h) OVER {own} AS ha", f"max(bin) OVER {own} AS last",
    ).filter("bin < last")
    gain = f"{penalty.score('gl', 'hl')} + {penalty.score('(ga - gl)', '(ha - hl)')} - {penalty.score('ga', 'ha')}"
    return rows.selectExpr("node", "feature", "bin", f"{gain} AS gain", "gl", "hl", "ga - gl AS gr", "ha - hl AS hr")


def gradient_sums(rows: DataFrame, margin: str, node: str, features: Sequence[int]) -> DataFrame:
    """Gradient and curvature of the logistic loss per node, feature and bin of ``(label, bins)``.

    ``margin`` and ``node`` are SQL text over the columns of ``rows``.
    """
    told = rows.selectExpr(
        f"{node} AS node", "label", f"1D / (1D + exp(-({margin}))) AS p",
        *[f"{i}L * {SPAN}L + coalesce(bins[{i}], {NO_BIN}L) AS c{k}" for k, i in enumerate(features)])
    # Feature and bin are one number, so that a row's cells are an array of plain numbers; halves are rounded up in size.
    unit = lambda x: f"cast(signum({x}) * floor(abs({x}) * {UNIT} + 0.5D) AS bigint)"
    slim = told.selectExpr(
        "node", f"{unit('(p - label)')} AS g", f"{unit('(p * (1D - p))')} AS h",
        f"explode(array({', '.join(f'c{k}' for k in range(len(features)))})) AS cell")
    summed = slim.groupBy("node", "cell").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    cells = summed.selectExpr("node", f"cast(floor((cell + {SPAN // 2}L) / {SPAN}) AS int) AS feature", "cell", "g", "h")
    bins = f"nullif(cell - feature * {SPAN}L, {NO_BIN}L)"
    return cells.selectExpr("node", "feature", f"cast({bins} AS int) AS bin", f"g / {UNIT}D AS g", f"h / {UNIT}D AS h")


def _reached(tree: dict, at: int, goes_left, found) -> str:
    """SQL text that leads a row down a tree: ``found(node)`` of the one it reaches."""
    node = tree.get(at)
    if not isinstance(node, tuple):
        return found(at)
    left, right = (_reached(tree, 2 * at + i, goes_left, found) for i in (0, 1))
    return f"CASE WHEN {goes_left(node)} THEN {left} ELSE {right} END"


@dataclass
class Boosted:
    """A fitted model: for each tree its nodes, 1 at the top and 2n, 2n + 1 below n.

    A node is ``(feature, bin, gain)`` if it splits, or the value that it adds.
    """

    cuts: list[list[float]]
    trees: list[dict[int, tuple[int, int, float] | float]] = field(default_factory=list)

    def margin(self, values: str) -> str:
        """SQL text: the sum of what all trees give for an array of feature values."""
        left = lambda n: f"{values}[{n[0]}] <= {float(self.cuts[n[0]][n[1]])!r}D"
        each = [_reached(t, 1, left, lambda at, t=t: f"{t[at]!r}D") for t in self.trees]
        return " + ".join(["0D", *each])

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802  (the name that Spark's models have)
        """Mean gain of the splits of each feature, as shares."""
        gains = [[n[2] for t in self.trees for n in t.values() if isinstance(n, tuple) and n[0] == i] for i in range(len(self.cuts))]
        means = [sum(g) / len(g) if g else 0.0 for g in gains]
        return DenseVector([m / (sum(means) or 1.0) for m in means])

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``probability`` (of 0 and of 1) and ``prediction`` to rows with a vector ``features``."""
        values = df.withColumn("_values", vector_to_array("features"))
        # Some trees at a time, so that no expression outgrows what Spark compiles.
        values = values.withColumn("_margin", F.lit(0.0))
        for start in range(0, len(self.trees), WRITTEN):
            part = Boosted(self.cuts, self.trees[start : start + WRITTEN])
            values = values.withColumn("_margin", F.expr(f"_margin + {part.margin('_values')}"))
        p = 1.0 / (1.0 + F.exp(-F.col("_margin")))
        scored = values.withColumn("_p", p).withColumns({
            "probability": array_to_vector(F.array(1.0 - F.col("_p"), F.col("_p"))),
            "prediction": (F.col("_p") > 0.5).cast("double"),
        })
        return scored.drop("_values", "_margin", "_p")

    def table(self, spark: SparkSession) -> DataFrame:
        """``(tree, node, feature, threshold, gain, value)``, one row a node; leaves have a value only."""
        rows = []
        for i, tree in enumerate(self.trees):
            for at, n in sorted(tree.items()):
                leaf = isinstance(n, float)
                rows.append((i, at, None, None, None, n) if leaf else (i, at, n[0], float(self.cuts[n[0]][n[1]]), n[2], None))
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, gain double, value double")

    @staticmethod
    def from_table(table: DataFrame) -> Boosted:
        """The model of a ``table``; a model is as small as its trees."""
        rows = table.collect()
        width = max([r.feature for r in rows if r.feature is not None], default=-1) + 1
        cuts = [sorted({r.threshold for r in rows if r.feature == i}) for i in range(width)]
        out = Boosted(cuts, [{} for _ in range(max([r.tree for r in rows], default=-1) + 1)])
        for r in rows:
            out.trees[r.tree][r.node] = r.value if r.feature is None else (r.feature, cuts[r.feature].index(r.threshold), r.gain)
        return out


def walk(rows: DataFrame, table: DataFrame, key: str, values: str = "values", depth: int = 3) -> DataFrame:
    """``(key, margin)``: the rows led down the tree table by joins, level by level.

    The same as ``Boosted.margin``, in relational steps that any engine can repeat.
    """
    top = table.filter("node = 1").select("tree", F.lit(1).alias("node"))
    trees = top.agg(F.collect_list("tree").alias("trees")).scalar()
    here = rows.select(key, values).withColumn("_trees", trees).select(key, values, F.explode("_trees").alias("tree"), F.lit(1).alias("node"))
    for _ in range(depth):
        step = here.join(table.select("tree", "node", "feature", "threshold"), ["tree", "node"])
        below = 2 * F.col("node") + (F.get(values, F.col("feature")) > F.col("threshold")).cast("int")
        here = step.select(key, values, "tree", F.when(F.col("feature").isNull(), F.col("node")).otherwise(below).alias("node"))
    leaves = here.join(table.filter("value IS NOT NULL").select("tree", "node", "value"), ["tree", "node"])
    return leaves.groupBy(key).agg(F.sum("value").alias("margin"))


def train_boosting(
    train: DataFrame, rounds: int = 100, depth: int = 3, rate: float = 0.3, rows: float = 0.7, columns: float = 0.4,
    penalty: Penalty = Penalty(), bins: int = 64, seed: int = 42,
) -> Boosted:
    """Boosted trees for rows of a vector ``features`` and a ``label`` of 0 or 1.

    Every tree sees a share ``rows`` of the rows, told by a hash of the row, and a share ``columns`` of the
    features, drawn once a tree. Features are cut at no more than ``bins`` approximate quantiles.
    """
    spark = train.sparkSession
    values = train.select(F.col("label").cast("double").alias("label"), vector_to_array("features").alias("values"))
    width = len(train.select("features").first()[0])
    marks = [i / bins for i in range(1, bins)]
    found = values.agg(*[F.percentile_approx(F.get("values", i), marks, 10_000).alias(f"c{i}") for i in range(width)]).first()
    model = Boosted([sorted(c for c in set(found[i] or []) if math.isfinite(c)) for i in range(width)])
    cut = lambda i: F.size(F.filter(F.array(*[F.lit(float(c)) for c in model.cuts[i]]), lambda c: c < F.get("values", i)))
    # A column for each feature, so that a level reads those drawn and no others.
    own = [f"b{i}" for i in range(width)]
    binned = [(cut(i) if model.cuts[i] else F.lit(0)).alias(own[i]) for i in range(width)]
    table = values.select("label", *binned, F.xxhash64("label", "values").alias("row"), F.lit(0.0).alias("margin"))

    def kept(df: DataFrame) -> DataFrame:
        path, df = scratch_dir(spark, "boosting"), df.select("label", *own, "row", "margin")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path).withColumn("bins", F.array(*own))

    by_bin = lambda n: f"bins[{n[0]}] <= {n[1]}"
    table = kept(table)
    drawn = random.Random(seed)
    for number in range(rounds):
        features = sorted(drawn.sample(range(width), max(1, int(columns * width))))
        seen = table.filter(F.pmod(F.xxhash64("row", F.lit(seed + number)), F.lit(10_000)) < int(rows * 10_000))
        tree: dict = {}
        for level in range(depth):
            open_ = [n for n in range(1 << level, 2 << level) if level == 0 or isinstance(tree.get(n), float)]
            if not open_:
                break
            sums = gradient_sums(seen, "margin", _reached(tree, 1, by_bin, str), features)
            # At most nodes x features x bins rows, whatever the table: one task works out their gains.
            gains = split_gains(sums.filter(f"node IN ({', '.join(map(str, open_))})").coalesce(1), penalty)
            fit = gains.filter(f"hl >= {penalty.least!r}D AND hr >= {penalty.least!r}D AND gain > 1e-9D")
            best = fit.groupBy("node").agg(F.expr(
                "max_by(struct(feature, bin, gain, gl, hl, gr, hr), struct(round(gain, 9), -feature, -bin)) AS s")).collect()
            for r in best:
                tree[r.node] = (r.s.feature, r.s.bin, r.s.gain)
                tree[2 * r.node] = rate * penalty.value(r.s.gl, r.s.hl)
                tree[2 * r.node + 1] = rate * penalty.value(r.s.gr, r.s.hr)
        if not tree:
            continue
        model.trees.append(tree)
        table = table.withColumn("margin", F.expr("margin + " + _reached(tree, 1, by_bin, lambda at: f"{tree[at]!r}D")))
        if number % WRITTEN == WRITTEN - 1:
            table = kept(table)
    return model
