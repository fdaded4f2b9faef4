"""Isolation forest: trees grown in parallel on executors from small uniform samples.

A tree needs only 256 rows whatever the table's size, so the table is read once to draw them from
all rows and never shuffled; scoring broadcasts at most 200 x 511 nodes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from flowsift.fixed_values import (
    ISOLATION_CONTAMINATION,
    ISOLATION_ROWS_PER_TREE,
    ISOLATION_TREES,
    SEED,
)
from flowsift.functions.scoring import NORMAL
from flowsift.operators.points import goes_left, matrix, point, seen
from flowsift.operators.rank import exact_quantile

DRAW_FACTOR = 4  # rows offered to a tree per row it keeps
HASH_RANGE = 2**60
NODES = "tree_id int, node_id int, feature int, slot int, threshold double, left int, right int, path double"


@dataclass(frozen=True)
class IsolationModel:
    """Trees as a node table, the score offset, and the training score range for calibration."""

    nodes: DataFrame
    rows_per_tree: int
    offset: float = 0.0
    minimum: float = 0.0
    maximum: float = 0.0

    @cached_property
    def packed(self) -> tuple[Broadcast, int, int]:
        """Node arrays, broadcast once per model, with the number of trees and nodes in a tree."""
        table = self.nodes.orderBy("tree_id", "node_id").toPandas()  # at most trees x 511 rows
        trees, width = int(table["tree_id"].max()) + 1, int(table["node_id"].max()) + 1
        at = (table["tree_id"].to_numpy(), table["node_id"].to_numpy())

        def grid(name: str, kind: type, empty: float) -> np.ndarray:
            values = np.full((trees, width), empty, dtype=kind)
            values[at] = table[name].to_numpy()
            return values.ravel()

        arrays = [grid(c, np.int32, -1) for c in ("feature", "slot", "left", "right")]
        arrays += [grid(c, np.float64, 0.0) for c in ("threshold", "path")]
        return self.nodes.sparkSession.sparkContext.broadcast(tuple(arrays)), trees, width


def training_rows(df: DataFrame, label: str = "label_id") -> DataFrame:
    """Normal rows, or all rows when no normal row exists; empty input is an error."""
    n, normal = df.agg(F.count("*"), F.count_if(F.col(label) == NORMAL)).first()
    if n == 0:
        raise ValueError("the isolation forest needs at least one training row")
    return df.where(F.col(label) == NORMAL) if normal else df


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` rows (Liu, Ting and Zhou 2008)."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    path = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, path))


def _draw(df: DataFrame, features: str, row_id: str, trees: int, wanted: int, rows: int, seed: int) -> DataFrame:
    """Exactly ``wanted`` rows per tree, uniform without replacement, from all rows of the table.

    A hash per tree and row keeps a surplus many deviations wide, so trimming to the exact count is
    always possible.
    """
    uniform = lambda *c: F.pmod(F.xxhash64(*c), F.lit(HASH_RANGE)) / F.lit(float(HASH_RANGE))
    keyed = df.select(F.col(row_id).alias("_k"), point(df, features).alias("_x"))
    tree_share = min(1.0, DRAW_FACTOR * wanted / rows + 64.0 / rows)
    # trees that draw the row are picked inside an array: no row is copied for a tree without it
    draws = F.transform(
        F.sequence(F.lit(0), F.lit(trees - 1)),
        lambda t: F.struct(t.alias("_t"), uniform(F.lit(seed + 1), F.col("_k"), t).alias("_u")),
    )
    offered = keyed.select("_k", "_x", F.inline(F.filter(draws, lambda d: d["_u"] < tree_share)))
    # each tree is offered about four times what it keeps: a bounded group
    rank = F.row_number().over(Window.partitionBy("_t").orderBy("_u", "_k"))
    return offered.withColumn("_r", rank).where(F.col("_r") <= wanted)


def fit(
    df: DataFrame,
    features: str = "features",
    row_id: str = "row_id",
    trees: int = ISOLATION_TREES,
    contamination: float = ISOLATION_CONTAMINATION,
    seed: int = SEED,
) -> IsolationModel:
    rows = df.count()
    if rows == 0:
        raise ValueError("the isolation forest needs at least one training row")
    wanted = min(ISOLATION_ROWS_PER_TREE, rows)
    drawn = _draw(df, features, row_id, trees, wanted, rows, seed)
    limit = math.ceil(math.log2(max(wanted, 2)))

    def grow(key: tuple, sample: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        sample = sample.sort_values("_r")
        numbers, hot = (np.vstack(sample[c].to_numpy()) for c in ("numbers", "hot"))
        codes = [(v, c) for c in range(hot.shape[1]) for v in np.unique(hot[:, c]) if v >= 0]
        feature = np.array([*range(numbers.shape[1]), *(v for v, _ in codes)], np.int64)
        slot = np.array([*[-1] * numbers.shape[1], *(c for _, c in codes)], np.int64)
        x = seen(numbers.astype(float), hot, feature, slot)  # features that no row has never vary
        rng = np.random.default_rng([seed, tree])
        out: list[list] = []
        todo = [(np.arange(len(x)), 0, -1, 0)]
        while todo:
            members, depth, parent, side = todo.pop()
            node = len(out)
            if parent >= 0:
                out[parent][5 + side] = node
            low, high = x[members].min(axis=0), x[members].max(axis=0)
            open_features = np.flatnonzero(high > low)
            out.append([tree, node, -1, -1, 0.0, -1, -1, depth + float(average_path(len(members)))])
            if depth >= limit or len(members) <= 1 or len(open_features) == 0:
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            out[node][2:5] = int(feature[f]), int(slot[f]), cut
            goes_left = x[members, f] <= cut
            todo.append((members[~goes_left], depth + 1, node, 1))
            todo.append((members[goes_left], depth + 1, node, 0))
        return pd.DataFrame(out, columns=[c.split()[0] for c in NODES.split(", ")])

    nodes = drawn.select("_t", "_r", "_x.numbers", "_x.hot").groupBy("_t").applyInPandas(grow, NODES)
    # at most trees x 511 rows: collected once so that every later use sees the same forest
    nodes = df.sparkSession.createDataFrame(nodes.toArrow())
    scores = score(IsolationModel(nodes, wanted), df, features).select("isolation_score").persist()
    try:
        low, high = calibrate(scores)
        offset = float(exact_quantile(scores, "isolation_score", contamination))
    finally:
        scores.unpersist()
    return IsolationModel(nodes, wanted, offset, low - offset, high - offset)


def score(
    model: IsolationModel, df: DataFrame, features: str = "features", out: str = "isolation_score"
) -> DataFrame:
    """Adds the raw decision score (lower is more anomalous) and ``isolation_outlier``."""
    shared, trees, width = model.packed
    start = np.arange(trees, dtype=np.int64) * width
    levels = math.ceil(math.log2(max(model.rows_per_tree, 2)))
    scale = float(average_path(model.rows_per_tree))
    offset = model.offset

    @F.arrow_udf("double")
    def decision(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        feature, slot, left, right, threshold, path = shared.value
        for numbers, hot in batches:
            x, codes = matrix(numbers, np.float64), matrix(hot, np.int64)
            parts = []
            for lo in range(0, len(x), 4096):
                part, code = x[lo : lo + 4096], codes[lo : lo + 4096]
                node = np.tile(start, len(part))
                row = np.repeat(np.arange(len(part)), trees)
                base = np.tile(start, len(part))
                live = np.arange(len(node))
                for _ in range(levels):
                    live = live[feature[node[live]] >= 0]
                    here = node[live]
                    turn = goes_left(part, code, row[live], feature[here], slot[here], threshold[here])
                    node[live] = np.where(turn, left[here], right[here]) + base[live]
                depth = path[node].reshape(len(part), trees).mean(axis=1)
                ratio = depth / scale if scale else np.ones(len(part))
                parts.append(-np.power(2.0, -ratio) - offset)
            yield pa.array(np.concatenate(parts) if parts else np.empty(0))

    scored = df.withColumn("_x", point(df, features))
    scored = scored.withColumn(out, decision(F.col("_x.numbers"), F.col("_x.hot"))).drop("_x")
    return scored.withColumn("isolation_outlier", F.col(out) < 0)


def calibrate(scored: DataFrame, column: str = "isolation_score") -> tuple[float, float]:
    """Lowest and highest training score; anything not finite is an error."""
    low, high, bad = scored.agg(
        F.min(column),
        F.max(column),
        F.count_if(F.col(column).isNull() | F.isnan(column) | (F.abs(column) == float("inf"))),
    ).first()
    if low is None or bad:
        raise ValueError("training scores are empty or not finite")
    return float(low), float(high)


# Tasks get this module's functions with the job, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
