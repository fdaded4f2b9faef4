"""Benchmark decontamination by Wu-Manber search over words."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from flowsift.llm.common import by_value, fresh, on_batches, stored, text_batches
from flowsift.llm.grams import ALNUM, Words, mix, words

WINDOW = 10
#: windows of test items that one pass over the documents searches for
BLOCK_WINDOWS = 1_000_000
TABLE_BITS = 22
LANE = 512
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _block(h: np.ndarray) -> np.ndarray:
    """The hash of the block of two words that ends at each word (of one word for the first)."""
    before = np.empty_like(h)
    before[:1], before[1:] = 0, h[:-1]
    return mix(before * _ODD + h)


def _slot(block: np.ndarray) -> np.ndarray:
    return (block >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def item_windows(items: DataFrame, item_id: str, text: str, size: int = WINDOW) -> DataFrame:
    """``(item, size, window)``: all windows of every item; a shorter item is one window of its size."""

    def make(batch):
        ids = batch.column("item").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for first, texts in text_batches(batch, "text"):
            w = words(texts, ALNUM)
            for k in range(len(texts)):
                lo, hi = w.first[k], w.first[k + 1]
                own = [w.data[a:b].tobytes() for a, b in zip(w.starts[lo:hi], w.ends[lo:hi])]
                m = min(size, len(own))
                for window in {b" ".join(own[i : i + m]) for i in range(len(own) - m + 1 if m else 0)}:
                    for column, value in zip(out, (ids[first + k], m, window)):
                        column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int32(), pa.binary()))], ["item", "size", "window"])

    narrow = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).alias("text"))
    return narrow.mapInArrow(on_batches(make), "item string, size int, window binary")


class Patterns:
    """The tables of one block of windows: a shift table and suffix buckets for each window size."""

    def __init__(self, windows: list[bytes], items: list[list[str | None]]):
        self.windows, self.items = windows, items
        sizes = np.array([w.count(b" ") + 1 for w in windows])
        self.by_size = []
        for m in sorted(set(sizes.tolist()), reverse=True):
            chosen = np.flatnonzero(sizes == m)
            w = words([windows[i].decode("utf-8", "surrogatepass") for i in chosen], ALNUM)
            grid = w.hashes.reshape(len(chosen), m)
            width = min(2, m)
            shift = np.full(1 << TABLE_BITS, m - width + 1, np.uint8)
            for end in range(width - 1, m):
                blocks = mix((grid[:, end - 1] if end else np.zeros(len(grid), np.uint64)) * (_ODD if width > 1 else np.uint64(0)) + grid[:, end])
                np.minimum.at(shift, _slot(blocks), m - 1 - end)
                last = blocks
            order = np.argsort(last, kind="stable")
            self.by_size.append((m, shift, last[order], chosen[order], grid[order, 0]))

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (first word, window) of all occurrences; they may run over the end of a text."""
        h, total = w.hashes, len(w.hashes)
        ends, found = [], []
        for m, shift, suffixes, chosen, prefixes in self.by_size:
            if total < m:
                continue
            blocks = _block(h) if m > 1 else mix(h)
            steps = shift[_slot(blocks)]
            lanes = np.arange(m - 1, total, LANE)
            stop = np.minimum(lanes + LANE, total)
            hits = []
            while len(lanes):  # all lanes skip ahead together
                step = steps[lanes]
                stand = step == 0
                hits.append(lanes[stand])
                lanes = lanes + np.where(stand, 1, step)
                live = lanes < stop
                lanes, stop = lanes[live], stop[live]
            at = np.concatenate(hits)
            lo, hi = np.searchsorted(suffixes, blocks[at], "left"), np.searchsorted(suffixes, blocks[at], "right")
            many = hi - lo
            at = np.repeat(at, many)
            entry = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
            same = prefixes[entry] == h[at - m + 1]
            ends.append(at[same] - m + 1)
            found.append(chosen[entry[same]])
        if not ends:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(ends), np.concatenate(found)


def _confirmed(w: Words, patterns: Patterns):
    """Per text: hit flags of its words and the windows found, each compared byte by byte."""
    firsts, which = patterns.find(w)
    order = np.argsort(firsts, kind="stable")
    firsts, which = firsts[order], which[order]
    owner = np.searchsorted(w.first, firsts, "right") - 1
    hit = np.zeros(len(w.hashes), bool)
    seen: dict[int, set[int]] = {}
    for a, p, doc in zip(firsts.tolist(), which.tolist(), owner.tolist()):
        window = patterns.windows[p]
        size = window.count(b" ") + 1
        if a + size > w.first[doc + 1]:
            continue
        if b" ".join(w.data[w.starts[k] : w.ends[k]].tobytes() for k in range(a, a + size)) == window:
            hit[a : a + size] = True
            seen.setdefault(doc, set()).add(p)
    return hit, seen


def search(docs: DataFrame, blocks: list, id_col: str, text: str) -> list[DataFrame]:
    """``(doc_id, key, n_words, spans, items)``: per row, hit runs of words ``[first, end)`` and items found."""
    schema = "doc_id long, key long, n_words long, spans array<struct<first:int,end:int>>, items array<string>"

    def searcher(shared):
        def make(batch):
            patterns = _tables(shared.value)
            ids, keys = batch.column("doc_id"), batch.column("key")
            for first, texts in text_batches(batch, "text"):
                w = words(texts, ALNUM)
                hit, seen = _confirmed(w, patterns)
                spans, items = [], []
                for k in range(len(texts)):
                    if k not in seen:
                        spans.append([])
                        items.append([])
                        continue
                    edges = np.flatnonzero(np.diff(hit[w.first[k] : w.first[k + 1]], prepend=False, append=False)).tolist()
                    spans.append([{"first": a, "end": b} for a, b in zip(edges[::2], edges[1::2])])
                    items.append(sorted({"" if i is None else i for p in seen[k] for i in patterns.items[p]}))
                n = len(texts)
                columns = [ids.slice(first, n), keys.slice(first, n), pa.array(np.diff(w.first).astype(np.int64)), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_words", "spans", "items"])

        return on_batches(make)

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text).alias("key"), F.col(text).alias("text"))
    return [narrow.mapInArrow(searcher(shared), schema) for shared in blocks]


_cache: dict = {}


def _tables(block) -> Patterns:
    """The tables of a broadcast block, made once in each worker."""
    if _cache.get("block") is not block:
        _cache.update(block=block, patterns=Patterns(*block))
    return _cache["patterns"]


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: ``(doc_id, key, n_words, spans, items)``.

    Windows of the items are searched for in blocks of at most ``BLOCK_WINDOWS``, a broadcast each,
    so a test set of any size is searched whole in bounded memory. In a pass, a shift table over
    hashed blocks of two words skips positions where no window can end, buckets of equal suffix
    blocks give the windows to compare, and the words are compared byte by byte. Nothing is
    shuffled for one block; the findings of several are joined by row.

    A null or empty text has no words. Items without words have no windows; an item without an id
    counts under the empty id. Rows that are alike get like rows. Without items, nothing is hit.
    """
    spark = docs.sparkSession
    windows = item_windows(items, item_id, item_text, size)
    windows = windows.groupBy("window").agg(F.array_sort(F.collect_set(F.coalesce("item", F.lit("")))).alias("items"))
    windows = stored(windows, "windows")
    number = windows.count()
    parts = max(1, -(-number // BLOCK_WINDOWS))
    blocks = []
    for part in range(parts):
        own = windows.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).toArrow()
        blocks.append(spark.sparkContext.broadcast((own.column("window").to_pylist(), own.column("items").to_pylist())))
    found = search(docs, blocks, id_col, text)
    if parts == 1:
        return found[0]
    rows = reduce(DataFrame.union, found)
    merged = rows.groupBy("doc_id", "key").agg(
        (F.count("*") / parts).cast("int").alias("copies"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).select(
        "doc_id", "key", "n_words", _united(F.col("spans")).alias("spans"), "items"
    )


def _united(spans):
    """Runs of words that overlap or touch, as one."""
    kind = "array<struct<first:int,end:int>>"

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["end"], span["end"]).alias("end"))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        return F.when((F.size(done) > 0) & (span["first"] <= last["end"]), grown).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), add)


def without_hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no window of the items occurs; null ids are judged as others."""
    key = fresh(docs, "_key")
    hit = decontaminate(docs, items, id_col, text).where(F.size("spans") > 0).select(F.col("key").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64(id_col, text)).join(hit, key, "left_anti").select(*docs.columns)


def report(found: DataFrame) -> DataFrame:
    """The digest of ``decontaminate``'s rows."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]))
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


by_value(__name__)
