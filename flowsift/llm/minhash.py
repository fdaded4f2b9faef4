"""Near-duplicate documents by HyperMinHash registers, banding and exact confirmation."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.llm.common import by_value, fresh, on_batches, stored, text_batches
from flowsift.llm.components import components
from flowsift.llm.grams import SOLID, Words, mix, words

REGISTERS = 128
BAND = 4
MANTISSA = 10
#: longs of a bitmap of differences
BITMAP = 4
#: how far an estimate may lie below the wanted similarity: over six standard deviations at 0.8
SLACK = 0.22
#: two registers of different sets agree by chance: leading zeros (a third) and mantissa bits
COLLISION = 1 / (3 * 2**MANTISSA)
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93], np.uint64)
_FILL = np.argsort(np.random.default_rng(7).random((REGISTERS, REGISTERS)), axis=1)


def shingle_sets(w: Words, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; of all its words if they are fewer."""
    h = w.hashes
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += h[k : k + n] * _STEPS[k % 6] * np.uint64(2 * (k // 6) + 1)
    rolled = mix(rolled)
    sets = []
    for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
        if hi - lo >= size:
            sets.append(np.unique(rolled[lo : hi - size + 1]))
        elif hi > lo:
            part = h[lo:hi] * _STEPS[: hi - lo]
            sets.append(mix(np.array([part.sum(dtype=np.uint64) + np.uint64(hi - lo)])))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def registers(hashes: np.ndarray) -> np.ndarray:
    """Compressed minima: the high bits of a hash choose a register, which keeps the least rest as
    its count of leading zeros and the ``MANTISSA`` bits after them. An empty register takes the
    value of the first filled one in a fixed random order of its own, so small sets compare too."""
    bits = REGISTERS.bit_length() - 1
    first = np.searchsorted(hashes >> np.uint64(64 - bits), np.arange(REGISTERS + 1, dtype=np.uint64))
    filled = first[1:] > first[:-1]
    least = (hashes[np.minimum(first[:-1], len(hashes) - 1)] << np.uint64(bits)) | np.uint64(1)
    exact = least.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    out = (exact - np.uint64(1023 << MANTISSA)).astype(np.uint16)
    empty = np.flatnonzero(~filled)
    if len(empty):
        order = _FILL[empty]
        out[empty] = out[order[np.arange(len(empty)), filled[order].argmax(axis=1)]]
    return out


def signatures(docs: DataFrame, id_col: str, text: str, size: int) -> DataFrame:
    """``(doc_id, n, same, registers)`` of every row; ``same`` names the set, null if it is empty."""

    def make(batch):
        ids = batch.column("doc_id")
        for first, texts in text_batches(batch, "text"):
            sets = shingle_sets(words(texts, SOLID), size)
            names, made = [], []
            for s in sets:
                if len(s):
                    names.append((int(mix(s).sum(dtype=np.uint64)) << 64 | int(np.bitwise_xor.reduce(mix(s * _STEPS[1])))).to_bytes(16, "big"))
                    made.append(registers(s).tobytes())
                else:
                    names.append(None)
                    made.append(None)
            counts = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), counts, pa.array(names, pa.binary()), pa.array(made, pa.binary())], ["doc_id", "n", "same", "registers"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(on_batches(make), "doc_id long, n long, same binary, registers binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """``(id, hashes)``: the full sets as bytes of sorted 64-bit hashes."""

    def make(batch):
        ids = batch.column("id")
        for first, texts in text_batches(batch, "text"):
            sets = [s.tobytes() for s in shingle_sets(words(texts, SOLID), size)]
            yield pa.RecordBatch.from_arrays([ids.slice(first, len(texts)), pa.array(sets, pa.binary())], ["id", "hashes"])

    return docs.mapInArrow(on_batches(make), "id long, hashes binary")


def _likely(pairs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` whose registers, corrected for chance collisions, may mean the similarity."""

    def make(batch):
        both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")]
        agree = (both[0] == both[1]).mean(axis=1)
        estimate = (agree - COLLISION) / (1 - COLLISION)
        return batch.select(["a", "b"]).filter(pa.array(estimate >= similarity - SLACK))

    one = reps.select(F.col("id").alias("a"), F.col("registers").alias("ra"))
    two = reps.select(F.col("id").alias("b"), F.col("registers").alias("rb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(on_batches(make), "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with ``100 * intersection >= percent * union`` on the full sets."""

    def make(batch):
        keep = []
        for a, b in zip(batch.column("ha"), batch.column("hb")):
            a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
            shared = 0
            if 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                at = np.searchsorted(a, b)
                at[at == len(a)] = 0
                shared = int((a[at] == b).sum())
            keep.append(shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared))
        return batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    return pairs.join(one, "a").join(two, "b").mapInArrow(on_batches(make), "a long, b long").distinct()


def _differences(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(hub, element, id, component, out, prefix, at, n, w, bits)``: how members differ from their hub.

    A member's differences come in one order: shingles that the hub lacks, then those that the
    member lacks, each by hash. ``w`` is their number ``n`` less the share of the size that a link
    may differ in, so two members are linked if they share at least half the sum of their ``w``.
    ``bits`` is a bitmap of all its differences. ``prefix`` marks those differences of which a link to an outside member shares one at least.
    """
    share = (100 - percent) / (100 + percent)
    fields = "hub long, element long, id long, component long, out boolean, prefix boolean, at int, n int, w double, bits array<long>"

    def make(batch):
        hubs, ids, parts, homes = (batch.column(c).to_pylist() for c in ("a", "b", "component", "home"))
        out: list[list] = [[] for _ in range(10)]
        for hub, own, part, home, ha, hb in zip(hubs, ids, parts, homes, batch.column("ha"), batch.column("hb")):
            one, two = (np.frombuffer(x.as_buffer(), np.uint64) for x in (ha, hb))
            both = np.intersect1d(one, two, assume_unique=True)
            differ = np.concatenate([np.setdiff1d(two, both, True), np.setdiff1d(one, both, True)])
            n, w = len(differ), len(differ) - share * len(two)
            # outside members aren't linked with the hub, so their w exceeds share * len(one)
            last = n - max(1, int(np.ceil((w + share * len(one)) / 2 - 1e-6)))
            many = n if part != home else min(n, last + 1)
            bitmap = np.zeros(BITMAP * 64, np.uint8)
            bitmap[(differ >> np.uint64(40)) % np.uint64(BITMAP * 64)] = 1
            bits = np.packbits(bitmap).view(np.int64).tolist()
            for c, v in zip(out, ([hub] * many, differ[:many].view(np.int64).tolist(), [own] * many, [part] * many, [part != home] * many, (np.arange(many) <= last).tolist(), range(many), [n] * many, [w] * many, [bits] * many)):
                c.extend(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], [f.split()[0] for f in fields.split(", ")])

    one = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"))
    two = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"))
    pairs = members.select(F.col("hub").alias("a"), F.col("id").alias("b"), "component", "home")
    return pairs.join(one, "a").join(two, "b").mapInArrow(on_batches(make), fields)


def _crossing(bands: DataFrame, parts: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that share a band, aren't in one component, and may be linked.

    Bands whose members are one component are done. In the others all members were compared with
    the band's hub, and a pair can be linked only if the two share many of their differences from
    it. So members meet by a shared difference, early in the order of both as prefix filters
    have it, if their bitmaps leave room for enough: copies that were each changed in their own way
    never meet, however many they are.
    """
    rows = stored(bands.join(parts, "id", "left").withColumn("component", F.coalesce("component", "id")), "bands")
    home = F.max(F.when(F.col("id") == F.col("hub"), F.col("component")))
    opened = rows.groupBy("band").agg(F.count("*").alias("k"), F.min("component").alias("low"), F.max("component").alias("high"), home.alias("home"))
    members = rows.join(opened.where("k > 2 and low != high").select("band", "home"), "band")
    members = members.where("id != hub").select("hub", "id", "component", "home").distinct()
    rows = stored(_differences(members, sets, percent), "differences")
    own = ["id", "component", "at", "n", "w", "bits"]
    x = rows.where("out").select("hub", "element", *(F.col(c).alias(f"{c}_x") for c in own))
    y = rows.where("prefix").select("hub", "element", "out", *(F.col(c).alias(f"{c}_y") for c in own))
    alone = reduce(Column.__add__, (F.bit_count(F.col("bits_x")[k].bitwiseAND(F.bitwise_not(F.col("bits_y")[k]))) for k in range(BITMAP)))
    met = x.join(y, ["hub", "element"]).where(
        F.expr("component_x != component_y and (not out or id_x < id_y) and least(n_x - at_x, n_y - at_y) >= (w_x + w_y) / 2 - 1e-6")
        & (F.col("n_x") - alone >= F.expr("(w_x + w_y) / 2 - 1e-6"))
    )
    # a member much larger than its hub may be linked with an outside one without a shared difference
    least = rows.groupBy("hub").agg(F.min(F.struct("w", "id", "component")).alias("m"))
    outside = rows.where("out").select("hub", F.col("id").alias("id_x"), F.col("component").alias("component_x"), F.col("w").alias("w_x")).distinct()
    sure = outside.join(least, "hub").where("w_x + m.w <= 1e-6 and component_x != m.component")
    pairs = met.select("id_x", "id_y").union(sure.select("id_x", F.col("m.id").alias("id_y")))
    return pairs.select(F.least("id_x", "id_y").alias("a"), F.greatest("id_x", "id_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, percent: int = 85) -> DataFrame:
    """Per row: ``(doc_id, n_shingles, component_id, kept)``; sets of ``size``-word shingles.

    Rows with one set are a class, named by their smallest id; one of a class is compared. Bands of
    four registers propose pairs (a pair at 0.8 is missed with a chance of 5e-8): first each
    member with the smallest id of its band, the hub, which is linear however many copies there
    are; then, after components are known, pairs across components that share enough differences
    from their hub to be linked. Estimates far below the similarity are left out, the rest is
    confirmed on full sets. Components are thus those of all proposed pairs, without all pairs of
    a group ever being made.

    Null texts and texts without words have an empty set and link with nothing. Rows that share an
    id are one document whose links are united. A row without an id links with nothing and is kept.
    """
    rows = stored(signatures(docs, id_col, text, size), "signatures")
    named = rows.where("doc_id is not null and same is not null")
    classes = named.groupBy("same").agg(F.min("doc_id").alias("id"), F.count("*").alias("members"))
    members = named.join(classes, "same")
    reps = stored(members.where("doc_id = id").select("id", "registers").distinct(), "representatives")
    same = members.where("doc_id != id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    width = 2 * BAND
    hashes = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substring("registers", i * width + 1, F.lit(width))))
    bands = reps.select(F.explode(hashes).alias("band"), "id")
    hubs = bands.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub != top").select("band", "hub")
    bands = stored(bands.join(hubs, "band"), "bands")
    tested = stored(bands.where("id != hub").select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    needed = bands.select("id").distinct()
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    sets = stored(_sets(texts.join(needed, "id", "left_semi"), size), "sets")
    similarity = percent / 100
    links = stored(_confirmed(_likely(tested, reps, similarity), sets, percent), "links")
    crossing = stored(_crossing(bands, components(links), sets, percent), "pairs")
    more = _confirmed(_likely(crossing, reps, similarity), sets, percent)
    parts = components(links.union(more).union(same))
    out = rows.join(parts.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def without_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the document of least id stays.

    Of rows that share that id one stays, the first by text. Rows without id stay.
    """
    key, row = fresh(docs, "_id"), fresh(docs, "_row")
    kept = near_duplicates(docs, id_col, text, size, percent).where("kept and doc_id is not null").select(F.col("doc_id").alias(key)).distinct()
    chosen = docs.withColumn(key, F.col(id_col).cast("long")).join(kept, key)
    order = Window.partitionBy(key).orderBy(text)
    first = chosen.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1)
    return first.select(*docs.columns).union(docs.where(F.col(id_col).isNull()))


by_value(__name__)
