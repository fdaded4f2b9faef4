"""Near-duplicate embeddings: collision counting over many one-dimensional projections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import by_value, on_batches, stored
from flowsift.llm.components import components

COSINE = 0.95
COLLISIONS = 3
#: chance that a pair just similar enough has too few collisions
MISS = 1e-5
#: tables in which tight groups are looked for
HUB_TABLES = 6


def calibrate(rows: int, cosine: float = COSINE) -> tuple[int, int, float]:
    """Sign bits per table, number of tables and half the window, for so many vectors.

    Bits keep a cell at a few unlike vectors; the window holds 95 % of the differences of a pair at
    the cosine; tables are added until such a pair collides fewer than ``COLLISIONS`` times with a
    chance of ``MISS`` at most.
    """
    angle = math.acos(cosine)
    bits = min(24, max(4, round(math.log2(max(rows, 2))) - 2))
    p = 0.95 * (1 - angle / math.pi) ** bits
    tables = COLLISIONS
    while sum(math.comb(tables, k) * p**k * (1 - p) ** (tables - k) for k in range(COLLISIONS)) > MISS:
        tables += 1
    return bits, tables, 1.96 * math.sqrt(2 - 2 * cosine)


def _units(batch: pa.RecordBatch, column: str = "embedding") -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors) per dimension; rows without a usable vector are in none."""
    values = batch.column(column)
    sizes = np.array([len(v) if v is not None else 0 for v in values.to_pylist()])
    groups = []
    for size in sorted(set(sizes.tolist()) - {0}):
        rows = np.flatnonzero(sizes == size)
        flat = values.take(pa.array(rows)).flatten()
        x = np.array(flat.to_pylist() if flat.null_count else flat.to_numpy(), np.float64).reshape(len(rows), size)
        top = np.abs(x).max(axis=1)
        good = np.isfinite(top) & (top > 0)  # a null component is not a number here
        x = x[good] / top[good, None]
        groups.append((rows[good], x / np.linalg.norm(x, axis=1, keepdims=True)))
    return groups


def unit_vectors(vectors: DataFrame, id_col: str, column: str) -> DataFrame:
    """``(vec_id, unit)`` with the unit vector as doubles; vectors that can't be compared are left out."""

    def make(batch):
        for rows, x in _units(batch):
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), pa.array([v.tobytes() for v in x], pa.binary())], ["vec_id", "unit"])

    narrow = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    return narrow.where("vec_id is not null").mapInArrow(on_batches(make), "vec_id long, unit binary")


def projections(units: DataFrame, bits: int, tables: int) -> DataFrame:
    """``(table, cell, p, vec_id)``: per table a cell of signs and one projection, drawn by a fixed seed."""

    def make(batch):
        ids, raw = batch.column("vec_id"), batch.column("unit").to_pylist()
        for size in {len(r) for r in raw}:
            rows = [k for k, r in enumerate(raw) if len(r) == size]
            x = np.frombuffer(b"".join(raw[k] for k in rows), np.float64).reshape(len(rows), -1)
            random = np.random.default_rng([11, size])
            own = ids.take(pa.array(rows))
            for t in range(tables):
                values = x @ random.standard_normal((x.shape[1], bits + 1))
                cell = (values[:, :bits] > 0) @ (1 << np.arange(bits)) + (size << 32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), t, np.int32)), pa.array(cell.astype(np.int64)), pa.array(values[:, bits].astype(np.float32)), own], ["table", "cell", "p", "vec_id"])

    return units.mapInArrow(on_batches(make), "table int, cell long, p float, vec_id long")


def _cosines(pairs: DataFrame, units: DataFrame, keep: str, extra: str = "") -> DataFrame:
    """``pairs (a, b, ...)`` with their cosine, those that pass the condition ``keep``."""

    def make(batch):
        rows = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float64).reshape(batch.num_rows, -1) if len({len(v) for v in batch.column(c).to_pylist()}) == 1 else None for c in ("ua", "ub")]
        if rows[0] is not None and rows[1] is not None and rows[0].shape == rows[1].shape:
            cos = np.einsum("ij,ij->i", rows[0], rows[1])
        else:
            both = zip(batch.column("ua").to_pylist(), batch.column("ub").to_pylist())
            cos = np.array([float(np.dot(np.frombuffer(a), np.frombuffer(b))) if len(a) == len(b) else -2.0 for a, b in both])
        kept = batch.drop_columns(["ua", "ub"])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(cos)], [*kept.schema.names, "cosine"])

    joined = pairs.join(units.select(F.col("vec_id").alias("a"), F.col("unit").alias("ua")), "a")
    joined = joined.join(units.select(F.col("vec_id").alias("b"), F.col("unit").alias("ub")), "b")
    order = [c for c in joined.columns if c not in ("ua", "ub")]
    schema = ", ".join([f"`{c}` {joined.schema[c].dataType.simpleString()}" for c in order] + ["cosine double"])
    return joined.select(*order, "ua", "ub").mapInArrow(on_batches(make), schema).where(keep)


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """Per row: ``(vec_id, n_links, component_id, kept)``; links are pairs with at least the cosine.

    In each of many tables vectors are dealt to cells by signs and ordered along one projection;
    two collide where they share a cell and lie in each other's window. Pairs with enough
    collisions are verified in double precision.

    Vectors in a tight group, within half the linking angle of one of them, are all linked with one
    another: their links are counted without making the pairs, and a group takes part in the
    tables as one row. So copies of one vector, however many, cost one row each; pairs are made
    only across groups.

    A vector that is null, empty, zero, or holds null or non-finite components, or whose id is null,
    links with nothing; so do vectors of different lengths. Rows that share an id are one vector.
    No rows give no rows.
    """
    units = stored(unit_vectors(vectors, id_col, column).dropDuplicates(["vec_id"]), "units")
    bits, tables, window = calibrate(units.count(), cosine)
    rows = stored(projections(units, bits, tables), "projections")
    tight = math.cos(math.acos(cosine) / 2 - 1e-7)
    cells = rows.where(F.col("table") < HUB_TABLES)
    hubs = cells.groupBy("table", "cell").agg(F.min("vec_id").alias("a"), F.max("vec_id").alias("top")).where("a != top").drop("top")
    spokes = cells.join(hubs, ["table", "cell"]).where("vec_id != a").select("a", F.col("vec_id").alias("b")).distinct()
    near = _cosines(spokes, units, f"cosine >= {tight!r}").groupBy("b").agg(F.min("a").alias("hub"))
    groups = units.select("vec_id").join(near.withColumnRenamed("b", "vec_id"), "vec_id", "left")
    groups = stored(groups.select("vec_id", F.coalesce("hub", "vec_id").alias("g")), "groups")
    # a hub may itself have joined another group; a group is named by its hub all the same
    seen = rows.join(groups, "vec_id").groupBy("table", "cell", "g").agg(F.min("p").alias("low"), F.max("p").alias("high"))
    left = seen.select("table", "cell", F.col("g").alias("ga"), F.col("low").alias("la"), F.col("high").alias("ha"))
    right = seen.select("table", "cell", F.col("g").alias("gb"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    met = left.join(right, ["table", "cell"]).where(f"ga < gb and la - {window!r} <= hb and lb - {window!r} <= ha")
    often = met.groupBy("ga", "gb").agg(F.count("*").alias("n")).where(f"n >= {COLLISIONS}")
    # a pair of groups can hold links only if the angle of their hubs is at most twice the linking angle
    reach = math.cos(2 * math.acos(cosine) + 1e-7)
    facing = _cosines(often.select(F.col("ga").alias("a"), F.col("gb").alias("b")), units, f"cosine >= {reach!r}")
    facing = facing.select(F.col("a").alias("ga"), F.col("b").alias("gb"))
    one, two = (groups.select(F.col("g").alias(g), F.col("vec_id").alias(v)) for g, v in (("ga", "a"), ("gb", "b")))
    links = stored(_cosines(facing.join(one, "ga").join(two, "gb").select("a", "b"), units, f"cosine >= {cosine!r}"), "links")
    sizes = groups.groupBy("g").agg(F.count("*").alias("size"), F.min("vec_id").alias("head"))
    ends = links.select(F.col("a").alias("vec_id")).union(links.select("b")).groupBy("vec_id").agg(F.count("*").alias("links"))
    grouped = groups.join(sizes, "g")
    parts = components(links.select("a", "b").union(grouped.where("vec_id != head").select(F.col("vec_id").alias("a"), F.col("head").alias("b"))))
    known = grouped.join(ends, "vec_id", "left").join(parts.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    known = known.select("vec_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n"), "component")
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id")).join(known, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))


by_value(__name__)
