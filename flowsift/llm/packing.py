"""Best-fit packing of documents into sequences of a fixed number of tokens."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.llm.common import by_value, on_batches, stored, text_batches
from flowsift.llm.grams import span_hashes

CAPACITY = 1024
END_ID = 2
SLOTS = 1 << 20
POOL = 1 << 23
LONG_TOKEN = 256
SPACE, WHITE, LETTER, NUMBER, OTHER = range(5)
_made: dict = {}


def _classes() -> np.ndarray:
    """The kind of every code point, as the byte-level pre-tokenizer tells them apart."""
    import regex

    kinds = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\s+", WHITE)):
        for m in regex.finditer(pattern, every):
            a, b = (ord(every[m.start()]), ord(every[m.end() - 1]) + 1)
            if a < 0xD800 < b:  # the gap of surrogates
                kinds[a:0xD800] = kinds[0xE000:b] = kind
            else:
                kinds[a:b] = kind
    kinds[32] = SPACE
    return kinds


def token_starts(codes: np.ndarray, bounds: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token begins; ``bounds`` has where each text begins, and the end.

    The rule is the published byte-level pattern: contractions; runs of letters, numbers or other
    signs with one space before them; white space, whose last character stands alone before text.
    """
    n = len(codes)
    kind = kinds[codes]
    white = kind <= WHITE
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    before = np.empty(n, np.uint8)
    before[0], before[1:] = OTHER, kind[:-1]
    first_in_text = first[:n]
    run = (np.where(white, WHITE, kind) != np.where(before <= WHITE, WHITE, before)) | first_in_text
    start = run & (white | (before != SPACE) | first_in_text)
    text_follows = np.zeros(n, bool)
    text_follows[:-1] = ~white[1:] & ~first_in_text[1:]
    start |= white & text_follows
    marks = np.flatnonzero((codes == 39) & start)
    if len(marks):
        ends = bounds[np.searchsorted(bounds, marks, "right")]
        padded = np.append(codes, [0, 0])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [115, 116, 109, 100]) & (marks + 1 < ends)
        pair = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        pair &= (marks + 2 < ends) & ~short
        for found, size in ((marks[short], 2), (marks[pair], 3)):
            for k in range(1, size):
                start[found + k] = False
            after = found + size
            start[after[after < n]] = True
    return start


class Ids:
    """Token ids of many texts. Ids of a pre-token are looked up in a table of fixed size.

    A slot holds the last pre-token of its hash; those that are not there, and long ones, go
    through the tokenizer. The table changes the time only.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.plain = Tokenizer.from_file(vocabulary)  # for pieces of texts that hold no added token
        self.plain.encode_special_tokens = True
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kinds = _classes()
        self.checked = np.zeros(0x110000, bool)
        self.checked[:128] = self.checked[0xD800:0xE000] = True
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at = np.zeros(SLOTS, np.int64)
        self.count = np.zeros(SLOTS, np.int32)
        self.pool, self.used = np.zeros(POOL, np.uint32), 0

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        made = self.plain.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(made.word_ids, np.int64), minlength=len(pieces))
        return np.array(made.ids, np.uint32), counts.astype(np.int32)

    def check(self, codes: np.ndarray) -> None:
        """Code points not met before get the kind that the tokenizer's own tables have."""
        seen = np.zeros(0x110000, bool)
        seen[codes] = True
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for code in np.flatnonzero(seen & ~self.checked).tolist():
            self.kinds[code] = next((k for k, c in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(cut(c + chr(code))) == 1), WHITE)
            self.checked[code] = True

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text; one with an added token goes through the tokenizer whole."""
        whole = [i for i, t in enumerate(texts) if any(a in t for a in self.added)]
        if not whole:
            return self.encode_plain(texts)
        own = {i: np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32) for i in whole}
        ids, counts = self.encode_plain(["" if i in own else t for i, t in enumerate(texts)])
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for i, part in own.items():
            parts[i], counts[i] = part, len(part)
        return np.concatenate(parts), counts

    def encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lens = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lens)])
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        self.check(codes)
        starts = np.flatnonzero(token_starts(codes, bounds, self.kinds))
        ends = np.append(starts[1:], len(codes))
        hashes = span_hashes(codes.astype(np.uint64) + np.uint64(1), starts, ends) | np.uint64(1)
        slots = (hashes >> np.uint64(44)).astype(np.int64)
        known = self.keys[slots] == hashes
        known &= ends - starts <= LONG_TOKEN
        at, count = self.at[slots], self.count[slots]
        pool = self.pool
        new = np.flatnonzero(~known)
        if len(new):
            _, pick, back = np.unique(np.where(ends[new] - starts[new] > LONG_TOKEN, new.astype(np.uint64) << np.uint64(1), hashes[new]), return_index=True, return_inverse=True)
            chosen = new[pick]
            ids, counts = self.encode_pieces([joined[a:b] for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())])
            if self.used + len(ids) > len(pool):
                old, upto = pool, self.used
                self.clear()
                pool = np.concatenate([old[:upto], ids])
                at[new], count[new] = (upto + np.cumsum(counts) - counts)[back], counts[back]
            else:
                pool[self.used : self.used + len(ids)] = ids
                places = self.used + np.cumsum(counts) - counts
                self.used += len(ids)
                at[new], count[new] = places[back], counts[back]
                self.keys[slots[chosen]], self.at[slots[chosen]], self.count[slots[chosen]] = 0, 0, 0
                last = {}
                for k, slot in enumerate(slots[chosen].tolist()):
                    last[slot] = k
                rows = np.fromiter(last.values(), np.int64)
                self.keys[slots[chosen][rows]] = hashes[chosen][rows]
                self.at[slots[chosen][rows]], self.count[slots[chosen][rows]] = places[rows], counts[rows]
        counts = count.astype(np.int64)
        shift = np.cumsum(counts) - counts
        ids = pool[np.arange(counts.sum()) + np.repeat(at - shift, counts)]
        done = np.concatenate([[0], np.cumsum(counts)])
        return ids, np.diff(done[np.searchsorted(starts, bounds)])


def _ids(vocabulary: str) -> Ids:
    if vocabulary not in _made:
        _made[vocabulary] = Ids(vocabulary)
    return _made[vocabulary]


def tokenized(docs: DataFrame, id_col: str, text: str | Column, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of every row: ``(doc_id, piece, start, length, ids_crc32[, ids])``.

    A document is its ids and the end id; only one longer than ``capacity`` is cut, into pieces of
    ``capacity``, the first of which takes what is left over. Null and empty texts are the end id
    alone. Rows with equal ids are packed each by itself.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def make(batch):
        encoder = _ids(vocabulary)
        out: list[list] = [[] for _ in range(5 + with_ids)]
        ids_in = batch.column(0).to_pylist()
        for first, texts in text_batches(batch, "text", 2_000_000):
            ids, counts = encoder.encode(texts)
            at = 0
            for row, n in enumerate(counts.tolist(), first):
                own = np.append(ids[at : at + n], END_ID).astype("<u4")
                at += n
                cut = (n + 1) % capacity or capacity
                for piece, start in enumerate([0, *range(cut, n + 1, capacity)]):
                    part = own[start : cut if not piece else start + capacity]
                    for column, value in zip(out, (ids_in[row], piece, start, len(part), zlib.crc32(part.tobytes()))):
                        column.append(value)
                    if with_ids:
                        out[5].append(part.astype(np.int32))
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names[: len(out)])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    return narrow.mapInArrow(on_batches(make), schema)


class Fit:
    """A segment tree over remaining capacities 0 to ``capacity``: which have open bins."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.tree = [0] * (2 * self.width)

    def add(self, room: int, bins: int) -> None:
        node = self.width + room
        while node:
            self.tree[node] += bins
            node >>= 1

    def tightest(self, size: int) -> int | None:
        """The least remaining capacity of at least ``size`` that an open bin has."""
        node = self.width + size
        if self.tree[node]:
            return size
        while node > 1:
            if not node & 1 and self.tree[node + 1]:
                node += 1
                while node < self.width:
                    node = 2 * node if self.tree[2 * node] else 2 * node + 1
                return node - self.width
            node >>= 1
        return None


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over how often each length occurs.

    Documents of one length are alike, and so are bins with the same room: one look-up in the tree
    places as many documents as go the same way. After a document, its bin is the tightest as long
    as another fits, so a bin takes ``room // length`` of them before the next is opened. Returns
    runs ``(length, first rank, documents, documents per bin, first bin, offset)``.
    """
    runs, tree, opened = [], Fit(capacity), 0
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room -> (first bin, bins)
    for size in sorted(lengths, reverse=True):
        rank, left = 0, lengths[size]
        while left:
            room = tree.tightest(size)
            if room is None:
                room, per = capacity, capacity // size
                first, bins = opened, -(-left // per)
                opened += bins
            else:
                first, bins = open_bins[room].pop()
                tree.add(room, -bins)
            per = room // size
            placed = min(left, per * bins)
            runs.append((size, rank, placed, per, first, capacity - room))
            full, rest = divmod(placed, per)
            for at, many, now in ((first, full, room - per * size), (first + full, 1 if rest else 0, room - rest * size), (first + full + bool(rest), bins - full - bool(rest), room)):
                if many and now:
                    open_bins.setdefault(now, []).append((at, many))
                    tree.add(now, many)
            rank, left = rank + placed, left - placed
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY, keys: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: no sequence holds more than ``capacity``.

    Only the number of pieces of each length (at most ``capacity`` numbers) comes to the driver,
    which plans runs of ranks; a run table of a few rows per length goes back. Ranks within a length
    are counted in shards by a hash of the keys, so no length, however frequent, is in one task.
    Equal rows differ only in their rank, which is theirs to swap. No rows give no rows.
    """
    spark = pieces.sparkSession
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pieces = pieces.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    counts = stored(pieces.groupBy("_shard", "length").agg(F.count("*").alias("_n")), "lengths")
    totals = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}
    if not totals:
        return pieces.drop("_shard").withColumns({"sequence_id": F.lit(None).cast("long"), "offset": F.lit(None).cast("long")})
    runs = np.array(plan(totals, capacity), np.int64)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    stride = int(runs[:, 1].max() + runs[:, 2].max()) + 1
    begin = runs[:, 0] * stride + runs[:, 1]
    before = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    order = Window.partitionBy("_shard", "length").orderBy(*keys)
    ranked = pieces.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.join(base, ["_shard", "length"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    ranked = ranked.drop("_shard", "_base")

    def place(batch):
        rank, length = (batch.column(c).to_numpy().astype(np.int64) for c in ("_rank", "length"))
        run = runs[np.searchsorted(begin, length * stride + rank, "right") - 1]
        bins, inside = np.divmod(rank - run[:, 1], run[:, 3])
        kept = batch.drop_columns(["_rank"])
        new = [pa.array(run[:, 4] + bins), pa.array(run[:, 5] + inside * length)]
        return pa.RecordBatch.from_arrays([*kept.columns, *new], [*kept.schema.names, "sequence_id", "offset"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema]
    return ranked.mapInArrow(on_batches(place), ", ".join([*fields, "sequence_id long", "offset long"]))


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their sequence and place in it; ``with_ids`` adds the ids."""
    return pack(stored(tokenized(docs, id_col, text, vocabulary, capacity, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` from packed pieces that carry their ids; a sequence is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def histogram(lengths: list[int]) -> dict[int, int]:
    return dict(Counter(lengths))


by_value(__name__)
