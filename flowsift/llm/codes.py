"""Vectors as short codes: each part's nearest codebook entry, found by slicing and intersecting bitmasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.llm.common import by_value, on_batches, stored
from flowsift.operators.bounded import salted_left_join

PARTS = 16
#: entries of a codebook at most: one bit each of a 64-bit mask
ENTRIES = 64
SCALE = 256
ROUNDS = 2
LIMB = 32
LONGEST = 2**63 - 1


class Slices:
    """A codebook of one part position, ready for exact nearest-entry searches.

    Per dimension the entries' coordinates are sorted, and ``masks[k]`` has the bits of the first
    ``k`` of them; so the entries within a range of coordinates are the exclusive or of two masks.
    """

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.sorted, self.masks = [], []
        for coordinates in entries.T:
            order = np.argsort(coordinates, kind="stable")
            bits = np.uint64(1) << order.astype(np.uint64)
            self.sorted.append(coordinates[order])
            self.masks.append(np.concatenate([np.zeros(1, np.uint64), np.bitwise_or.accumulate(bits)]))
        self.radius = self._first_radius()

    def _first_radius(self) -> int:
        """The median distance of an entry to the next one: most parts have few entries that near."""
        gaps = []
        for k, entry in enumerate(self.entries):
            others = np.delete(self.entries, k, axis=0) - entry
            if len(others):
                gaps.append(math.isqrt(int((others * others).sum(axis=1).min())))
        return max(1, sorted(gaps)[len(gaps) // 2]) if gaps else 1

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Per row of ``x`` the mask of entries that differ by at most its radius in every dimension."""
        found = np.full(len(x), (1 << len(self.entries)) - 1, np.uint64)
        for own, coordinates, masks in zip(x.T, self.sorted, self.masks):
            low = np.searchsorted(coordinates, own - radius, "left")
            high = np.searchsorted(coordinates, own + radius, "right")
            found &= masks[high] ^ masks[low]
        return found

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the least of several, and its squared distance.

        An entry at distance ``r`` lies in the box of radius ``r``. So a best candidate at most as
        far as the box reaches is the nearest; one beyond it gives the next radius, and an empty
        box is doubled.
        """
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), x.dtype)
        todo = np.arange(len(x))
        radius = np.full(len(x), self.radius, x.dtype)
        while len(todo):
            masks = self.within(x[todo], radius)
            bits = np.unpackbits(masks.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            rows, entry = np.nonzero(bits)
            apart = x[todo[rows]] - self.entries[entry]
            if len(rows):
                named = (apart * apart).sum(axis=1).astype(x.dtype) * ENTRIES + entry
                met = np.flatnonzero(np.diff(rows, prepend=-1))
                best = np.minimum.reduceat(named, met)
                met = rows[met]
                far = best // ENTRIES
                done = far <= radius[met] * radius[met]
                index[todo[met[done]]], distance[todo[met[done]]] = (best[done] % ENTRIES).astype(np.int64), far[done]
                beyond = far[~done]
                radius[masks == 0] *= 2
                radius[met[~done]] = np.array([math.isqrt(d) for d in beyond], object) + 1 if x.dtype == object else np.sqrt(beyond).astype(np.int64) + 1
                left = np.ones(len(todo), bool)
                left[met[done]] = False
                todo, radius = todo[left], radius[left]
            else:
                radius = radius * 2
        return index, distance


def _whole(x: float) -> int:
    return math.floor(x * SCALE) if abs(x) < 1e300 else math.floor(x) * SCALE


def quantised(batch: pa.RecordBatch, column: str = "embedding") -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, floors of 256 times the components) per length; rows without a usable vector are in none.

    64-bit integers where squared distances fit them, whole Python numbers otherwise.
    """
    values = batch.column(column)
    sizes = pc.fill_null(pc.list_value_length(values), -1).to_numpy()
    flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64)  # a null component is not a number
    begin = np.cumsum(np.maximum(sizes, 0)) - np.maximum(sizes, 0)
    groups = []
    for size in sorted(set(sizes.tolist()) - {-1}):
        rows = np.flatnonzero(sizes == size)
        x = flat.reshape(-1, size) if size and len(rows) == len(sizes) else flat[begin[rows][:, None] + np.arange(size)]
        good = np.isfinite(x).all(axis=1)
        rows, x = rows[good], x[good]
        if not len(rows):
            continue
        top = np.abs(x).max() * SCALE + SCALE if size else 0.0
        if size * top * top < 2**50:
            groups.append((rows, np.floor(x * SCALE).astype(np.int64)))
        else:
            groups.append((rows, np.array([[_whole(v) for v in row] for row in x.tolist()], object)))
    return groups


def bounds(size: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; as equal as can be where ``size`` isn't a multiple."""
    edges = [k * size // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:]))


class Book:
    """The codebooks of all part positions, for vectors of one length."""

    def __init__(self, entries: list[np.ndarray], size: int):
        self.entries, self.size = entries, size
        self.slices = [Slices(e) for e in entries]
        top = max((abs(int(v)) for e in entries for v in e.ravel()), default=0) + 1
        self.small = size * top * top < 2**50

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts) entry indexes and squared distances."""
        if x.dtype != object and not self.small:
            x = x.astype(object)
        made = [s.nearest(x[:, a:b]) for s, (a, b) in zip(self.slices, bounds(self.size, len(self.slices)))]
        return np.stack([m[0] for m in made], axis=1), np.stack([m[1] for m in made], axis=1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(int(v)) for e in self.entries for v in e.ravel()).encode()).hexdigest()


def _exact(entries: list[list[int]], width: int) -> np.ndarray:
    """Entries as 64-bit integers, or as whole Python numbers where squares might not fit."""
    top = max((abs(v) for e in entries for v in e), default=0) + 1
    kind = np.int64 if top < 2**25 else object
    return np.array(entries, kind).reshape(len(entries), width)


def _usable(column: str) -> Column:
    return F.expr(f"`{column}` is not null and forall(`{column}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")


def _first_books(rows: DataFrame, parts: int, entries: int) -> dict[int, list[np.ndarray]]:
    """Per length the parts of the vectors with the smallest ids, which are at most ``entries`` rows."""
    order = Window.partitionBy("size").orderBy(F.col("vec_id").asc_nulls_last(), "embedding")
    first = rows.withColumn("size", F.size("embedding")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= entries)
    vectors: dict[int, list[tuple[int, list[int]]]] = {}
    for r in first.select("size", "n", "embedding").collect():
        vectors.setdefault(r["size"], []).append((r["n"], [_whole(float(v)) for v in r["embedding"]]))
    return {
        size: [_exact([v[a:b] for _, v in sorted(got)], b - a) for a, b in bounds(size, parts)]
        for size, got in sorted(vectors.items())
    }


def _sums(rows: DataFrame, entries: dict[int, list[np.ndarray]]) -> DataFrame:
    """``(size, part, entry, place, limb, total)``: sums of the components assigned to each entry.

    A task adds up its rows and gives each sum in limbs of 32 bits, so totals are exact whatever
    the number of rows; ``place`` -1 counts them.
    """
    names = ["size", "part", "entry", "place", "limb"]

    def run(batches):
        books, held = {size: Book(e, size) for size, e in entries.items()}, {}
        for batch in batches:
            for _, x in quantised(batch) if batch.num_rows else ():
                size = x.shape[1]
                index, _ = books[size].assign(x)
                for part, (a, b) in enumerate(bounds(size, index.shape[1])):
                    own = index[:, part]
                    many = np.bincount(own, minlength=ENTRIES)
                    order = np.argsort(own, kind="stable")
                    used = np.flatnonzero(many)
                    starts = (np.cumsum(many) - many)[used]
                    added = np.add.reduceat(x[order, a:b], starts, axis=0) if b > a else np.zeros((len(used), 0), np.int64)
                    for entry, n, sums in zip(used.tolist(), many[used].tolist(), added.tolist()):
                        total = held.setdefault((size, part, entry), [0] * (1 + b - a))
                        for place, v in enumerate([n, *sums]):
                            total[place] += int(v)
        out: list[list[int]] = [[] for _ in range(6)]
        for (size, part, entry), total in held.items():
            for place, v in enumerate(total, -1):
                limb, sign = 0, -1 if v < 0 else 1
                v = abs(v)
                while v:
                    for c, w in zip(out, (size, part, entry, place, limb, sign * (v & (1 << LIMB) - 1))):
                        c.append(w)
                    v, limb = v >> LIMB, limb + 1
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in out[:5]), pa.array(out[5], pa.int64())], [*names, "total"])

    made = rows.select("embedding").mapInArrow(run, ", ".join(f"{n} int" for n in names) + ", total long")
    return made.groupBy(*names).agg(F.sum("total").alias("total"))


def fit(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks per vector length: for each part position, rows of at most ``entries`` entries.

    They start as the parts of the vectors with the smallest ids; each round assigns every part of
    every row to its nearest entry and moves an entry to the floor of its parts' mean, or leaves it
    where it has none. Only sums per entry and component come to the driver, as many numbers as
    the codebooks have.
    """
    if entries > ENTRIES:
        raise ValueError(f"a codebook has at most {ENTRIES} entries")
    rows = _narrow(vectors, id_col, column)
    books = _first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        totals: dict[tuple, int] = {}
        for r in _sums(rows, books).collect():
            key = (r["size"], r["part"], r["entry"], r["place"])
            totals[key] = totals.get(key, 0) + (r["total"] << (LIMB * r["limb"]))
        for size, own in books.items():
            for part, table in enumerate(own):
                moved = [
                    [totals.get((size, part, k, j), 0) // n for j in range(table.shape[1])] if (n := totals.get((size, part, k, -1), 0)) else [int(v) for v in row]
                    for k, row in enumerate(table)
                ]
                own[part] = _exact(moved, table.shape[1])
    return books


def _narrow(vectors: DataFrame, id_col: str, column: str, *more: Column) -> DataFrame:
    kind = vectors.schema[column].dataType.simpleString()
    value = F.col(column) if kind in ("array<float>", "array<double>") else F.col(column).cast("array<double>")
    return vectors.select(F.col(id_col).alias("vec_id"), value.alias("embedding"), *more).where(_usable("embedding"))


def encode(vectors: DataFrame, books: dict[int, list[np.ndarray]], id_col: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """``(vec_id, label, code, error, codebooks_sha256)`` of every usable vector; nothing is shuffled.

    An error beyond a long is the largest long.
    """
    rows = _narrow(vectors, id_col, column, F.col(label).alias("label"))
    hexes = np.array([list(f"{k:02x}".encode()) for k in range(ENTRIES)], np.uint8)

    def run(batches):
        made = {size: Book(e, size) for size, e in books.items()}
        digests = {size: book.digest() for size, book in made.items()}
        for batch in batches:
            for at, x in quantised(batch) if batch.num_rows else ():
                index, distance = made[x.shape[1]].assign(x)
                error = distance.sum(axis=1)
                if error.dtype == object:
                    error = np.array([min(int(e), LONGEST) for e in error], np.int64)
                codes = hexes[index].reshape(len(at), -1)
                codes = codes.view(f"S{codes.shape[1]}").ravel().astype(str)
                own = batch.take(pa.array(at))
                columns = [own.column("vec_id"), own.column("label"), pa.array(codes, pa.string()), pa.array(error), pa.array([digests[x.shape[1]]] * len(at), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, codebooks_sha256 string")


def compress(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every usable vector.

    Components become whole numbers, ``floor(256 * x)``; a vector is cut into ``parts`` consecutive
    parts, each named by the nearest entry of its position's codebook (squared Euclidean distance,
    the lower index of several). ``error`` is the sum of the parts' squared distances,
    ``label_error`` that of all rows with the same label, nulls together.

    Left out are vectors that are null or hold null or non-finite components. Rows that share an id
    or are alike are vectors of their own; where ids tie or are null (last), vectors order the rows
    that codebooks start from. Vectors of different lengths have codebooks of their own; an empty
    vector has parts without components, all entry 0. No rows give no rows. Sums beyond a long are the
    largest long.
    """
    coded = stored(encode(vectors, fit(vectors, id_col, column, parts, entries, rounds), id_col, column, label), "codes")
    named = coded.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("")))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONGEST).cast("decimal(38,0)")).cast("long")
    totals = named.groupBy("_label").agg(total.alias("label_error"))
    met = salted_left_join(named, totals, "_label", ["vec_id", "code"])
    return met.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


by_value(__name__)
