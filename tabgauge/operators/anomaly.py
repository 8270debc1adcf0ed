"""Anomaly detection with an isolation forest.

Each tree is grown in its own task from a small sample; the sampling is part of the
method. Equal rows are counted first, and a hash of seed and row decides how many of a
row's copies are drawn, and by which trees: as if each copy were drawn on its own, so a row
that fills a third of the table has a third of each sample, and the forest does not depend
on how the table is split or on tasks that run again. About 2 x trees x sample copies are
drawn in all, whatever the table's size. The forest (at most trees x 2 x sample nodes) is
then sent to all tasks, which score their rows batch by batch. The cut between normal and
anomalous rows is an exact quantile of all scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabgauge.functions.checkpoints import settled
from tabgauge.functions.columns import field_of, names_of_kind, percent, present, ref
from tabgauge.operators.distribution import histogram
from tabgauge.operators.quantiles import exact_quantiles

_NODES = (
    "tree int, node int, feature int, threshold double, left_node int, right_node int,"
    " path_length double"
)


@dataclass(frozen=True)
class Forest:
    trees: int = 100
    sample: int = 256
    contamination: float = 0.05
    seed: int = 42


def numeric_choice(df: DataFrame, columns: list[str] | None, fewest: int = 2) -> list[str]:
    """The numeric columns to use; at least two are needed."""
    numeric = names_of_kind(df, "Numeric")
    chosen = numeric if columns is None else [c for c in columns if c in numeric]
    if len(chosen) < fewest:
        raise ValueError(f"needs at least {fewest} numeric columns, found {len(chosen)}")
    return chosen


def mean_filled(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as doubles with missing values replaced by the mean."""
    values = {c: present(field_of(df, c)).cast("double") for c in columns}
    row = df.agg(*[F.avg(v).alias(f"a{i}") for i, v in enumerate(values.values())]).first()
    return [
        F.coalesce(v, F.lit(0.0 if mean is None else mean)) for v, mean in zip(values.values(), row)
    ]


def expected_path(count: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``count`` values."""
    n = np.asarray(count, dtype=float)
    safe = np.maximum(n, 3.0)
    longer = 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, longer))


def _grow(rows: np.ndarray, depth_limit: int, random: np.random.Generator) -> list[tuple]:
    """Nodes of one tree: (node, feature, threshold, left, right, path)."""
    nodes: list[tuple] = [()]
    waiting = [(0, rows, 0)]
    while waiting:
        node, part, depth = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= depth_limit or len(part) <= 1 or not len(splittable):
            nodes[node] = (node, -1, 0.0, node, node, depth + float(expected_path(len(part))))
            continue
        feature = int(random.choice(splittable))
        threshold = float(random.uniform(low[feature], high[feature]))
        left = part[:, feature] <= threshold
        children = (len(nodes), len(nodes) + 1)
        nodes += [(), ()]
        nodes[node] = (node, feature, threshold, *children, 0.0)
        waiting.append((children[0], part[left], depth + 1))
        waiting.append((children[1], part[~left], depth + 1))
    return nodes


def copies_drawn(copies: int, trees: int, rate: float, chance: float, random: np.random.Generator) -> np.ndarray:
    """How many copies of a row each tree draws.

    Every copy is drawn by every tree with probability `rate`. The number drawn in all is
    where `chance`, uniform between 0 and 1, falls in its distribution; it is 0 up to
    (1 - rate) ** (copies * trees).
    """
    every = copies * trees
    if rate >= 1:
        return np.full(trees, copies)
    if every * rate > 50:
        drawn = int(random.binomial(every, rate))
    else:
        drawn, here = 0, (1 - rate) ** every
        below = here
        while below < chance and drawn < every and here > 0:
            here *= (every - drawn) / (drawn + 1) * rate / (1 - rate)
            below += here
            drawn += 1
    # one copy's places with the trees follow each other; a place is taken once
    if every <= 1_000_000:
        places = random.choice(every, drawn, replace=False)
    else:
        places = random.integers(0, every, drawn)
    return np.bincount(places // copies, minlength=trees)


def draw(df: DataFrame, features: list[Column], forest: Forest, count: int) -> DataFrame:
    """tree, f0, f1 ..., copies: what each tree sees of a table of `count` rows."""
    names = [f"f{i}" for i in range(len(features))]
    # minus zero is zero, so that it is in one group and hashed as one
    table = df.select(*[(f + F.lit(0.0)).alias(n) for f, n in zip(features, names)])
    # Twice as many copies as needed are drawn, so that no tree runs short.
    rate = min(1.0, 2.0 * forest.sample / max(count, 1))
    place = F.xxhash64(F.lit(forest.seed), *names)
    chance = F.xxhash64(F.lit(forest.seed + 1), *names).bitwiseAND((1 << 53) - 1) / float(1 << 53)
    none = F.pow(F.lit(1.0 - rate), F.col("copies") * forest.trees)
    grouped = table.groupBy(*names).agg(F.count(F.lit(1)).alias("copies"))
    some = grouped.withColumns({"place": place, "chance": chance}).where(F.col("chance") >= none)
    trees = forest.trees

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            taken = [
                copies_drawn(int(n), trees, rate, float(u), np.random.default_rng([abs(int(p)), int(p < 0)]))
                for n, p, u in zip(batch["copies"], batch["place"], batch["chance"])
            ]
            row, tree = np.nonzero(np.array(taken).reshape(-1, trees))
            found = batch[names].iloc[row].reset_index(drop=True)
            found.insert(0, "tree", tree)
            found["copies"] = [int(taken[r][t]) for r, t in zip(row, tree)]
            yield found

    fields = ", ".join(f"{n} double" for n in names)
    return some.mapInPandas(drawn, f"tree int, {fields}, copies long")


def fit_forest(df: DataFrame, features: list[Column], forest: Forest, count: int) -> pd.DataFrame:
    """The nodes of all trees, grown in parallel; ``count`` is the number of rows."""
    names = [f"f{i}" for i in range(len(features))]
    sample = min(forest.sample, count)
    depth_limit = math.ceil(math.log2(max(sample, 2)))
    seed = forest.seed

    def grow(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        random = np.random.default_rng([seed, tree])
        values = np.repeat(rows[names].to_numpy(dtype=float), rows["copies"].to_numpy(), axis=0)
        values = values[np.lexsort(values.T)]
        if len(values) > sample:
            values = values[random.choice(len(values), sample, replace=False)]
        nodes = _grow(values, depth_limit, random)
        grown = pd.DataFrame(
            nodes, columns=["node", "feature", "threshold", "left_node", "right_node", "path_length"]
        )
        grown.insert(0, "tree", tree)
        return grown

    return draw(df, features, forest, count).groupBy("tree").applyInPandas(grow, _NODES).toPandas()


def joined_paths(df: DataFrame, features: list[Column], nodes: pd.DataFrame, key: list[str], sample: int) -> DataFrame:
    """key columns and path_length, the mean over all trees, by joins with the forest as a table.

    What the vectorised scores rest on, said with joins alone.
    """
    forest = F.broadcast(df.sparkSession.createDataFrame(nodes, _NODES))
    values = F.array(*features).alias("values")
    rows = df.select(*[ref(c) for c in key], values, F.explode(F.sequence(F.lit(0), F.lit(int(nodes["tree"].max())))).alias("tree"))
    rows = rows.withColumn("node", F.lit(0))
    for _ in range(math.ceil(math.log2(max(sample, 2)))):
        goes_left = F.get("values", F.greatest(F.col("feature"), F.lit(0))) <= F.col("threshold")
        following = F.when(F.col("feature") < 0, F.col("node")).when(goes_left, F.col("left_node"))
        rows = rows.join(forest, ["tree", "node"]).select(
            *[ref(c) for c in key], "values", "tree", following.otherwise(F.col("right_node")).alias("node")
        )
    ended = rows.join(forest.select("tree", "node", "path_length"), ["tree", "node"])
    return ended.groupBy(*[ref(c).alias(c) for c in key]).agg(F.avg("path_length").alias("path_length"))


def _scorer(df: DataFrame, nodes: pd.DataFrame, sample: int):
    """A vectorised function from features to scores (lower: more anomalous)."""
    trees = []
    for _, tree in nodes.sort_values(["tree", "node"]).groupby("tree"):
        trees.append(
            (
                tree["feature"].to_numpy(),
                tree["threshold"].to_numpy(),
                tree["left_node"].to_numpy(),
                tree["right_node"].to_numpy(),
                tree["path_length"].to_numpy(),
            )
        )
    shared = df.sparkSession.sparkContext.broadcast(trees)
    usual = float(expected_path(sample)) or 1.0
    levels = math.ceil(math.log2(max(sample, 2)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            values = batch.to_numpy(dtype=float)
            rows = np.arange(len(values))
            total = np.zeros(len(values))
            for feature, threshold, left, right, path in shared.value:
                node = np.zeros(len(values), dtype=np.int64)
                for _ in range(levels):
                    split = feature[node]
                    goes_left = values[rows, np.maximum(split, 0)] <= threshold[node]
                    node = np.where(goes_left, left[node], right[node])
                total += path[node]
            yield pd.Series(-np.power(2.0, -total / (len(shared.value) * usual)))

    return score


def detect_anomalies(
    df: DataFrame,
    columns: list[str] | None = None,
    forest: Forest = Forest(),
) -> DataFrame:
    """The table with ``anomaly_score`` (below 0: anomalous) and ``is_anomaly``.

    Rows are scored once, into shared storage; the cut and the result are both taken from
    there. Equal rows have equal scores.
    """
    chosen = numeric_choice(df, columns)
    rows = df.count()
    features = mean_filled(df, chosen)
    nodes = fit_forest(df, features, forest, rows)
    if nodes.empty:
        return df.withColumn("anomaly_score", F.lit(None).cast("double")).withColumn(
            "is_anomaly", F.lit(False)
        )
    score = _scorer(df, nodes, min(forest.sample, rows))
    vector = F.struct(*[f.alias(f"f{i}") for i, f in enumerate(features)])
    scored = settled(df.withColumn("anomaly_score", score(vector)))
    found = exact_quantiles(scored, {"cut": F.col("anomaly_score")}, [forest.contamination])
    cut = found["cut"][0]
    return scored.withColumn("anomaly_score", F.col("anomaly_score") - F.lit(cut)).withColumn(
        "is_anomaly", F.col("anomaly_score") < 0
    )


def anomaly_summary(scored: DataFrame) -> DataFrame:
    """Number and share of anomalies, and the lowest score among them."""
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if("is_anomaly").alias("anomalies"),
        F.coalesce(F.min(F.when(F.col("is_anomaly"), F.col("anomaly_score"))), F.lit(0.0)).alias(
            "threshold_line"
        ),
    ).withColumn("anomaly_percentage", percent(F.col("anomalies"), F.col("rows"), 0.0))


def score_histogram(scored: DataFrame, bins: int = 50) -> DataFrame:
    """Chart data: distribution of the anomaly scores."""
    return histogram(scored.select("anomaly_score"), bins)


def top_anomalies(scored: DataFrame, rows: int = 20, order_by: list[str] | None = None) -> DataFrame:
    """The most anomalous rows, or the first anomalous rows in a stated order."""
    return scored.where("is_anomaly").orderBy(*(order_by or ["anomaly_score"])).limit(rows)
