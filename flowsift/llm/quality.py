"""Quality classifier: supervised subword embeddings, averaged per document, trained by numpy SGD."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowsift.llm.common import by_value, fresh, give_back, on_batches, stored, text_batches
from flowsift.llm.grams import SOLID, VALUES, mix, span_hashes

BUCKET_BITS = 17
DIMENSIONS = 8
#: labelled rows of each class that the model is fitted on at most, the first by a hash of their id
FIT_ROWS = 3000
#: bytes of a gram of characters
GRAMS = (2, 4)
EPOCHS = 8
RATE = 0.5
BATCH = 32
#: characters whose features are worked out at once
BATCH_CHARS = 500_000


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and character n-grams of many texts: (buckets, number per text).

    Grams are of bytes, case kept, and run over spaces, so they see signs and word ends.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    values = VALUES[data]
    inside = SOLID[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    shift = np.uint64(64 - BUCKET_BITS)
    starts, names = edges[::2], span_hashes(values, edges[::2], edges[1::2])
    text = np.searchsorted(bounds, starts, "right")
    again = np.flatnonzero((names[1:] == names[:-1]) & (text[1:] == text[:-1])) + 1
    # a word, and one feature for any word that repeats the word before it
    found = [(starts, names >> shift), (starts[again], np.zeros(len(again), np.uint64))]
    for size in GRAMS:
        n = max(0, len(data) - size)
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + values[k : k + n]
        at = np.arange(n)
        owner_end = np.repeat(bounds[1:], np.diff(bounds))[:n]
        whole = at + size < owner_end  # the space after a text belongs to none
        found.append((at[whole], mix(rolled[whole] + np.uint64(size)) >> shift))
    starts = np.concatenate([f[0] for f in found])
    owner = np.searchsorted(bounds, starts, "right") - 1
    order = np.argsort(owner, kind="stable")
    buckets = np.concatenate([f[1] for f in found])[order].astype(np.int64)
    return buckets, np.bincount(owner, minlength=len(texts))


def counted(docs: DataFrame) -> DataFrame:
    """``(label, buckets, weights)``: the distinct features of each text and their shares of it."""

    def make(batch):
        labels = batch.column("label")
        for first, texts in text_batches(batch, "text", BATCH_CHARS):
            buckets, counts = features(texts)
            at, rows = 0, ([], [])
            for n in counts.tolist():
                own, many = np.unique(buckets[at : at + n], return_counts=True)
                at += n
                rows[0].append(own.astype(np.int32))
                rows[1].append((many / max(n, 1)).astype(np.float32))
            columns = [labels.slice(first, len(texts)), pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[1], pa.list_(pa.float32()))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "buckets", "weights"])

    return docs.mapInArrow(on_batches(make), "label int, buckets array<int>, weights array<float>")


@dataclass
class Model:
    """What is left to know of the embeddings for two classes: each bucket's share of the logit."""

    logits: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        buckets, counts = features(texts)
        sums = np.bincount(np.repeat(np.arange(len(texts)), counts), self.logits[buckets], len(texts))
        z = sums / np.maximum(counts, 1) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 5) -> Model:
    """Embeddings and a softmax over two classes, by stochastic gradient descent.

    A document's vector is the mean of its features' vectors. Classes weigh alike. The step falls
    to zero linearly. Without rows of both classes the model is the plain frequency of label 1.
    """
    ones = sum(r[0] for r in rows)
    if not 0 < ones < len(rows):
        return Model(np.zeros(1 << BUCKET_BITS), 0.0 if not rows else (4.0 if ones else -4.0))
    random = np.random.default_rng(seed)
    vectors = random.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BUCKET_BITS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((2, DIMENSIONS), np.float32)
    bias = np.zeros(2, np.float32)
    weight = {1: len(rows) / (2 * ones), 0: len(rows) / (2 * (len(rows) - ones))}
    total, done = EPOCHS * len(rows), 0
    for _ in range(EPOCHS):
        order = random.permutation(len(rows))
        for lo in range(0, len(rows), BATCH):
            part = [rows[k] for k in order[lo : lo + BATCH]]
            sizes = [len(r[1]) for r in part]
            owner = np.repeat(np.arange(len(part)), sizes)
            buckets = np.concatenate([r[1] for r in part])
            shares = np.concatenate([r[2] for r in part])[:, None]
            hidden = np.zeros((len(part), DIMENSIONS), np.float32)
            np.add.at(hidden, owner, shares * vectors[buckets])
            z = hidden @ out.T + bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            error = z / z.sum(axis=1, keepdims=True)
            labels = np.array([r[0] for r in part])
            error[np.arange(len(part)), labels] -= 1
            error *= np.array([weight[x] for x in labels.tolist()], np.float32)[:, None]
            step = RATE * (1 - done / total)
            back = error @ out
            out -= step * error.T @ hidden / len(part) * 4
            bias -= step * error.mean(axis=0)
            np.add.at(vectors, buckets, -step * shares * back[owner] * 4)
            done += len(part)
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(id_col: str = "doc_id") -> Column:
    """True for the fifth of ids that no label is learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", most: int = FIT_ROWS) -> Model:
    """A model from labelled rows that aren't held out: ``most`` of each class, in order of a hash.

    Rows with other labels than 0 and 1, or without id, aren't learned from; rows alike in id, text
    and label are one. An id that is labelled both ways counts for both. The chosen rows' features
    meet in one task, which trains and returns the model: the driver gets ``2 ** BUCKET_BITS`` numbers.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out()).distinct()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]

    def first(rows: DataFrame, *more: str) -> DataFrame:
        zero, one = (rows.where(F.col("label") == k).orderBy(*by_hash, *more).limit(most) for k in (0, 1))
        return zero.union(one)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    met = texts.join(F.broadcast(first(known)), "doc_id").withColumn("name", F.xxhash64("text"))
    alone = met.groupBy("doc_id", "label", "name").agg(F.min("text").alias("text"))
    chosen = stored(first(alone, "name"), "fit")
    rows = counted(chosen.repartition(24, "doc_id").select("label", "text"))

    def learn(batches):
        got = []
        for batch in batches:
            columns = [batch.column(c) for c in ("buckets", "weights")]
            flat = [(c.values.to_numpy(), c.offsets.to_numpy()) for c in columns]
            for k, one in enumerate(batch.column("label").to_pylist()):
                got.append((one, *(v[o[k] : o[k + 1]] for v, o in flat)))
        got.sort(key=lambda r: (r[0], len(r[1]), r[1][:64].tobytes(), r[2][:64].tobytes()))
        model = train(got)
        got.clear()
        yield pa.RecordBatch.from_arrays([pa.array([model.logits.tobytes()], pa.binary()), pa.array([model.bias])], ["logits", "bias"])
        give_back()

    made = rows.repartition(1).mapInArrow(learn, "logits binary, bias double").first()
    return Model(np.frombuffer(made["logits"]), made["bias"]) if made else train([])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = 0.3, into: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` with ``score`` (0 to 1) and ``predicted`` appended, from the whole text alone.

    The two replace columns of the names ``into``.

    Rows that are alike get the same score. No rows give no rows. Null and empty texts get the score of no features. Nothing is shuffled; the model is one
    broadcast of ``2 ** BUCKET_BITS`` numbers whatever the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.logits, model.bias))  # plain arrays: executors need no package

    def make(batch):
        model = Model(*shared.value)
        made = [model.scores(texts) for _, texts in text_batches(batch.select([own]), own, BATCH_CHARS)]
        kept = batch.drop_columns([own])
        return pa.RecordBatch.from_arrays([*kept.columns, pa.array(np.concatenate(made))], [*kept.schema.names, into[0]])

    docs = docs.drop(*into)
    own = fresh(docs, "_text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{into[0]}` double"])
    scored = docs.withColumn(own, F.col(text)).mapInArrow(on_batches(make), schema)
    return scored.withColumn(into[1], (F.col(into[0]) >= threshold).cast("int"))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of every document, with whether its label was held out."""
    model = fit(docs, labels)
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


by_value(__name__)
