"""Removal of long repeated byte strings: anchors, and deep-shallow sorting of what follows them."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowsift.llm.common import by_value, on_batches, stored, text_batches
from flowsift.llm.grams import SOLID, VALUES, Words, mix, words

LENGTH = 400
GRAM = 32
#: positions of a gram within a string of LENGTH bytes
STARTS = LENGTH - GRAM + 1
HALF = LENGTH // 2
CHUNK = 1 << 22
SHALLOW = 16
#: rows of one group that a task sorts at most; larger groups are compared by hashes of whole strings
GROUP_ROWS = 100_000
BLOCK_ROWS = 20_000
#: words of a passage, and of the gram by which a window of so many is known
PASSAGE = 51
WORD_GRAM = 16
#: of the tables between the steps, whose size bounds how much a disk can hold
CODEC = "zstd"
#: Spark's setting under which the shuffle files of an execution go at its end
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def anchors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Positions that strings of LENGTH bytes choose by their content alone.

    Each string within a text takes its gram of least hash, the last of several alike; so equal
    strings take the same gram at the same place. ``bounds``: where texts begin, and the end.
    """
    n = len(data)
    if n < LENGTH or n >= 1 << 24:
        return np.zeros(0, np.int64)
    h, step, factor = VALUES[data], 1, np.uint64(0x9E3779B97F4A7C15)
    while step < GRAM:
        h = h[:-step] * factor + h[step:]
        factor = factor * factor
        step *= 2
    place = np.uint64((1 << 24) - 1) - np.arange(len(h), dtype=np.uint64)
    least = (mix(h) & ~np.uint64((1 << 24) - 1)) | place
    step = 1
    while 2 * step <= STARTS:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    least = np.minimum(least[: len(least) - (STARTS - step)], least[STARTS - step :])
    ends = np.repeat(bounds[1:], np.diff(bounds))[: len(least)]
    chosen = least[np.arange(len(least)) + LENGTH <= ends]
    if not len(chosen):
        return np.zeros(0, np.int64)
    chosen = chosen[np.concatenate([[True], chosen[1:] != chosen[:-1]])]
    return np.unique(((1 << 24) - 1) - (chosen & np.uint64((1 << 24) - 1)).astype(np.int64))


def _own_anchors(texts: list[bytes]) -> list[list[int]]:
    """Anchors of each text; many short texts are looked at together, a long one in overlapping parts."""
    found: list[list[int]] = [[] for _ in texts]
    parts: list[tuple[int, int, bytes]] = []
    size = 0

    def flush():
        bounds = np.cumsum([0, *(len(p[2]) for p in parts)])
        at = anchors(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), bounds)
        owner = np.searchsorted(bounds, at, "right") - 1
        for a, o in zip((at - bounds[owner]).tolist(), owner.tolist()):
            found[parts[o][0]].append(a + parts[o][1])
        parts.clear()

    for k, text in enumerate(texts):
        for lo in range(0, len(text) - LENGTH + 1, CHUNK):
            parts.append((k, lo, text[lo : lo + CHUNK + LENGTH - 1]))
            size += len(parts[-1][2])
            if size >= CHUNK:
                flush()
                size = 0
    if parts:
        flush()
    return [sorted(set(f)) for f in found]


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]


def _runs(batch: pa.RecordBatch):
    """Slices of a batch with a bounded number of bytes (or one text)."""
    first, size = 0, 0
    for row, n in enumerate(len(t) for t in _bytes(batch)):
        size += n
        if size >= 2 * CHUNK:
            yield batch.slice(first, row + 1 - first)
            first, size = row + 1, 0
    if first < batch.num_rows:
        yield batch.slice(first)


def anchor_rows(docs: DataFrame) -> DataFrame:
    """``(key, pos, around, after, before, wordy)``: anchors with hashes of their surroundings.

    ``around`` is the hash of the bytes within reach of a string through the anchor; ``after`` and
    ``before`` are those of the HALF bytes on either side (null if the text ends earlier). ``wordy``
    surroundings hold a passage of whole words.
    """

    def make(batch):
        for part in _runs(batch):
            keys, columns = part.column("key").to_pylist(), [[] for _ in range(6)]
            texts = _bytes(part)
            found = _own_anchors(texts)
            edges = np.flatnonzero(np.diff(SOLID[np.frombuffer(b" ".join([*texts, b""]), np.uint8)], prepend=False, append=False))
            sizes = np.array([len(t) for t in texts])
            base, many = np.cumsum(sizes + 1) - sizes - 1, np.array([len(own) for own in found])
            at = np.array([a for own in found for a in own], np.int64)
            low, high = np.maximum(0, at - STARTS + 1), np.minimum(np.repeat(sizes, many), at + LENGTH)
            base = np.repeat(base, many)
            wordy = np.searchsorted(edges[1::2], base + high, "right") - np.searchsorted(edges[::2], base + low) >= PASSAGE
            reach = zip(low.tolist(), high.tolist(), wordy.tolist())
            for key, text, own in zip(keys, texts, found):
                for a in own:
                    lo, hi, wordy = next(reach)
                    around = xxhash.xxh3_64_intdigest(text[lo:hi], a - lo)
                    after = _signed(xxhash.xxh3_64_intdigest(text[a : a + HALF], 1)) if a + HALF <= len(text) else None
                    before = _signed(xxhash.xxh3_64_intdigest(text[a - HALF : a], 2)) if a >= HALF else None
                    for c, v in zip(columns, (key, a, _signed(around), after, before, wordy)):
                        c.append(v)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["key", "pos", "around", "after", "before", "wordy"])

    return docs.mapInArrow(on_batches(make), "key long, pos int, around long, after long, before long, wordy boolean")


def word_windows(found: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(windows, anchors, grams)``: where windows of PASSAGE words begin, the anchor each takes, and hashes of the grams.

    A window takes its gram of least hash, the last of several alike, as strings do theirs.
    """
    n = len(found.hashes)
    if n < PASSAGE:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, step = found.hashes, 1
    while step < WORD_GRAM:
        h = h[:-step] * np.uint64(pow(int(FACTOR), step, 1 << 64)) + h[step:]
        step *= 2
    h = mix(h)
    low = np.uint64((1 << 32) - 1)
    least = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    step, wide = 1, PASSAGE - WORD_GRAM + 1
    while 2 * step <= wide:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < wide:
        least = np.minimum(least[: len(least) - (wide - step)], least[wide - step :])
    ends = np.repeat(found.first[1:], np.diff(found.first))[: len(least)]
    windows = np.flatnonzero(np.arange(len(least)) + PASSAGE <= ends)
    return windows, (low - (least[windows] & low)).astype(np.int64), h


def word_anchor_rows(docs: DataFrame) -> DataFrame:
    """``(key, pos, gram)``: the word at which an anchor begins, and the hash of its gram of words."""

    def make(batch):
        keys = batch.column("key")
        for first, texts in text_batches(batch, "text"):
            found = words(texts, SOLID)
            _, anchors_, grams = word_windows(found)
            at = np.unique(anchors_)
            owner = np.searchsorted(found.first, at, "right") - 1
            columns = [keys.take(pa.array(first + owner)), pa.array((at - found.first[owner]).astype(np.int32)), pa.array(grams[at].view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "pos", "gram"])

    return docs.mapInArrow(on_batches(make), "key long, pos int, gram long")


def _window_names(text: bytes, asked: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows of the asked anchors begin, in words, and their hashes."""
    found = words([text.decode("utf-8", "surrogatepass")], SOLID)
    windows, anchors_, _ = word_windows(found)
    chosen = windows[np.isin(anchors_, asked)]
    n = len(found.hashes)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes * np.cumprod(np.full(n, FACTOR)))])
    shift = np.cumprod(np.full(n, INVERSE))
    return chosen, mix((sums[chosen + PASSAGE] - sums[chosen]) * shift[chosen]).view(np.int64)


class BlindTrie:
    """A trie over strings that share a prefix: nodes know where they branch, not what they skip."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | int | None = None  # a node is [depth, {byte: child}], a leaf a list of rows

    @staticmethod
    def _byte(s: bytes, depth: int) -> int:
        return s[depth] if depth < len(s) else -1

    def add(self, row: int) -> None:
        s = self.strings[row]
        if self.root is None:
            self.root = (row,)
            return
        node, path = self.root, []
        while isinstance(node, list):  # blindly down: any leaf below agrees as far as one can tell
            path.append(node)
            children = node[1]
            node = children.get(self._byte(s, node[0])) or next(iter(children.values()))
        other = self.strings[node[0]]
        same = _common(s, other)
        if same == len(s) == len(other):
            self._replace(path, s, node + (row,))
            return
        while path and path[-1][0] > same:
            path.pop()
        if path and path[-1][0] == same:
            path[-1][1][self._byte(s, same)] = (row,)
            return
        below = path[-1][1][self._byte(s, path[-1][0])] if path else self.root
        self._put(path, s, [same, {self._byte(other, same): below, self._byte(s, same): (row,)}])

    def _put(self, path, s, node) -> None:
        if path:
            path[-1][1][self._byte(s, path[-1][0])] = node
        else:
            self.root = node

    def _replace(self, path, s, leaf) -> None:
        self._put(path, s, leaf)

    def order(self) -> list[int]:
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, list):
                todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
            else:
                out.extend(node)
        return out


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n - 1  # the first difference lies in [lo, hi]
    while lo < hi:
        mid = (lo + hi) // 2
        if a[lo : mid + 1] == b[lo : mid + 1]:
            lo = mid + 1
        else:
            hi = mid
    return lo


def deep_shallow(groups: np.ndarray, strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by group, then string; and what each shares with the one before (-1 across groups).

    A multikey sort takes eight bytes as one sign and goes SHALLOW bytes deep in groups of more
    than one; what is still alike then is put in order by a blind trie.
    """
    n = len(strings)
    lengths = np.array([len(s) for s in strings])
    width = max(8, -(-SHALLOW // 8) * 8)
    shallow = np.frombuffer(b"".join(s[:width].ljust(width, b"\0") for s in strings), ">u8").reshape(n, -1)
    order = np.argsort(groups, kind="stable")
    fresh = np.concatenate([[True], np.diff(groups[order]) != 0])
    for k in range(shallow.shape[1]):
        part = np.cumsum(fresh)
        alone = fresh & np.concatenate([fresh[1:], [True]])
        rows = np.flatnonzero(~alone)
        sub = order[rows]
        again = np.lexsort((np.minimum(lengths[sub], 8 * k + 8), shallow[sub, k], part[rows]))
        order[rows] = sub[again]
        key = shallow[order, k]
        size = np.minimum(lengths[order], 8 * k + 8)
        fresh = fresh | np.concatenate([[True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])])
    starts = np.flatnonzero(fresh)
    ends = np.append(starts[1:], n)
    for a, b in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        trie = BlindTrie(strings)
        for row in order[a:b].tolist():
            trie.add(row)
        order[a:b] = trie.order()
    ordered = order.tolist()
    shared = [-1] + [_common(strings[x], strings[y]) for x, y in zip(ordered, ordered[1:])]
    shared = np.array(shared)
    shared[1:][np.diff(groups[order]) != 0] = -1
    return order, shared


def repeated_offsets(groups: np.ndarray, near: np.ndarray, after: list[bytes], before: list[bytes]) -> list[tuple[int, int, int]]:
    """``(row, least, most)``: runs of ``u`` for which a row's first ``HALF - u`` bytes of ``after`` and
    first ``u`` of ``before`` are those of another row of its group.

    ``near`` rows run over u from 0 to HALF, the others from 1 to STARTS - 1 - HALF. Classes of equal
    prefixes of any length are read off the two sorted orders, so no two rows are compared.
    """
    n = len(groups)
    if n < 2:
        return []
    sides = []
    for strings in (after, before):
        order, shared = deep_shallow(groups, strings)
        longest = np.zeros(n, np.int64)
        longest[order] = np.maximum(shared, np.append(shared[1:], -1))
        sides.append((order, shared, longest, np.array([len(s) for s in strings])))
    live = np.flatnonzero(sides[0][2] + sides[1][2] >= HALF)
    if len(live) < 2:
        return []
    hit = np.zeros((len(live), HALF + 2), np.int8)
    for u in range(HALF + 1):
        (ao, ash, al, an), (bo, bsh, bl, bn) = sides
        t = HALF - u
        may = live[(al[live] >= t) & (bl[live] >= u) & (near[live] | ((u > 0) & (u < STARTS - HALF)))]
        if len(may) < 2:
            continue
        ca, cb = np.empty(n, np.int64), np.empty(n, np.int64)
        ca[ao] = np.cumsum(ash < t)
        cb[bo] = np.cumsum(bsh < u)
        may = may[(an[may] >= t) & (bn[may] >= u)]
        pair = ca[may] * (n + 1) + cb[may]
        _, back, many = np.unique(pair, return_inverse=True, return_counts=True)
        hit[np.searchsorted(live, may[many[back] > 1]), u + 1] = 1
    edges = np.diff(hit, axis=1, append=0)
    rows, at = np.nonzero(edges)
    begun = edges[rows, at] == 1
    return [(int(live[r]), int(a), int(b) - 1) for r, a, b in zip(rows[begun], at[begun], at[~begun])]


def _group_spans(rows: DataFrame) -> DataFrame:
    """``(key, first, end)`` from rows of groups that come sorted; whole groups are taken together."""
    names = ["group", "near", "key", "pos", "after", "before"]

    def solve(table: pa.Table):
        groups = np.unique(table.column("group").to_numpy(), return_inverse=True)[1] * 2 + table.column("near").to_numpy(zero_copy_only=False)
        near = np.array(table.column("near").to_pylist(), bool)
        keys, pos = table.column("key").to_pylist(), table.column("pos").to_pylist()
        out = ([], [], [])
        for row, least, most in repeated_offsets(groups, near, table.column("after").to_pylist(), table.column("before").to_pylist()):
            back = 0 if near[row] else HALF
            for c, v in zip(out, (keys[row], pos[row] - most - back, pos[row] - least - back + LENGTH)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], ["key", "first", "end"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch.select(names))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                table = pa.Table.from_batches(held)
                last = table.column("group")[-1].as_py()
                groups = table.column("group").to_numpy()
                cut = int(np.flatnonzero(groups != last)[-1]) + 1 if (groups != last).any() else 0
                if cut:
                    yield solve(table.slice(0, cut))
                    held = table.slice(cut).to_batches()
                    size = table.num_rows - cut
        if size:
            yield solve(pa.Table.from_batches(held))

    sorted_rows = rows.repartition("group").sortWithinPartitions("group", "near")
    return sorted_rows.mapInArrow(run, "key long, first int, end int")


def _surroundings(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of groups, with the bytes of the text that may still differ on either side of an anchor.

    Where words are asked for (``near`` is null), the rows are the windows of the anchor at that
    word, alike ones of a text once: their group is the hash of the window's words.
    """
    asked = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "group", "near", "hot")).alias("asked"))
    schema = "group long, near boolean, hot boolean, key long, pos int, after binary, before binary"

    def make(batch):
        for part in _runs(batch):
            columns = [[] for _ in range(7)]
            for key, text, asked in zip(part.column("key").to_pylist(), _bytes(part), part.column("asked").to_pylist()):
                at_words = [x["pos"] for x in asked if x["near"] is None]
                if at_words:
                    where, names = _window_names(text, at_words)
                    one = np.sort(np.unique(names, return_index=True)[1])  # in order of place, which takes less room
                    names = names[one]
                    none, met = [None] * len(one), next(x["hot"] for x in asked if x["near"] is None)
                    for c, v in zip(columns, (names.tolist(), none, [met] * len(one), [key] * len(one), where[one].tolist(), none, none)):
                        c += v
                for x in asked:
                    a = x["pos"]
                    if x["near"] is None:
                        continue
                    if x["near"]:
                        after, before = text[a + HALF : a + LENGTH], text[max(0, a - HALF) : a][::-1]
                    else:
                        after, before = text[a : a + HALF], text[max(0, a - STARTS + 1) : a - HALF][::-1]
                    for c, v in zip(columns, (x["group"], x["near"], x["hot"], key, a, after, before)):
                        c.append(v)
            types = [pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["group", "near", "hot", "key", "pos", "after", "before"])

    return docs.join(asked, "key").select("key", "text", "asked").mapInArrow(on_batches(make), schema)


def _hot_spans(rows: DataFrame) -> DataFrame:
    """The same for groups too large for a task: each string by its hash, counted in all tasks."""

    def make(batch):
        columns = [[] for _ in range(3)]
        for group, near, key, pos, after, before in zip(*(batch.column(c).to_pylist() for c in ("group", "near", "key", "pos", "after", "before"))):
            back = 0 if near else HALF
            for u in range(0 if near else 1, (HALF if near else STARTS - 1 - HALF) + 1):
                if len(after) >= HALF - u and len(before) >= u:
                    name = xxhash.xxh3_128_digest(before[:u][::-1] + after[: HALF - u] + group.to_bytes(8, "big", signed=True) + bytes([u, near]))
                    for c, v in zip(columns, (name, key, pos - u - back)):
                        c.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int32()))], ["name", "key", "first"])

    strings = rows.mapInArrow(on_batches(make), "name binary, key long, first int")
    again = strings.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    return strings.join(again, "name").select("key", "first", (F.col("first") + LENGTH).alias("end"))


def _unmet_anchors(docs: DataFrame, met: DataFrame) -> DataFrame:
    """``(key, pos, met)``: anchors of words that are also in another document, if one of these isn't ``met`` yet."""
    rows = stored(word_anchor_rows(docs), "words", CODEC)
    rows = rows.join(met.withColumn("met", F.lit(True)), "key", "left")
    shared = rows.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count_if(F.col("met").isNull()).alias("unmet"))
    return rows.join(shared.where("low != high and unmet > 0").select("gram"), "gram").select("key", "pos", F.col("met").isNotNull().alias("met"))


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a step go once its table is written.

    Otherwise they stay until the driver happens to collect its garbage, and those of all steps add up.
    Frames made within are for one execution; a second one would shuffle anew. The setting is the
    session's: what other threads run in it meanwhile is under it, too. Spark before 4.1 ignores it.
    """
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)


def repeated_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(key, first, end)``: bytes of strings of LENGTH that also start elsewhere; and ``(key, place)``: shared passages.

    ``docs`` has ``(key, text)``. An anchor whose whole surroundings occur again settles all strings
    through it. Of the rest, those that share HALF bytes on one side with another are grouped by
    them, one anchor standing for equal surroundings, and sorted in their group. Spans may overlap.

    A passage is PASSAGE words in a row that another key has too. Settled surroundings with so many
    whole words are one. Keys without any are looked at by windows of words: those whose anchor is a
    gram that other keys have, too, are compared by a hash of all their words.

    The end of a span may lie behind that of its text.
    """
    long = docs.where(F.octet_length("text") >= LENGTH)
    rows = stored(anchor_rows(long), "anchors", CODEC)
    classes = rows.groupBy("around").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "pos", "after", "before")).alias("one"), F.max("key").alias("high")
    )
    # most surroundings occur once: what only the others need isn't written for them
    several = lambda c: F.when(F.col("n") > 1, F.col(c)).alias(c)
    classes = stored(classes.select("n", "one", several("around"), several("high")), "surroundings", CODEC)
    again = classes.where("n > 1").select("around", (F.col("one.key") != F.col("high")).alias("elsewhere"))
    settled = stored(rows.join(again, "around").select("key", "pos", F.expr("elsewhere and wordy").alias("passage")), "settled", CODEC)
    met = settled.where("passage").select("key", F.col("pos").alias("place"))
    sides = F.explode(F.array(F.struct(F.lit(True).alias("near"), F.col("one.after").alias("group")), F.struct(F.lit(False).alias("near"), F.col("one.before").alias("group"))))
    open_rows = classes.select("n", F.col("one.key").alias("key"), F.col("one.pos").alias("pos"), sides.alias("s"))
    open_rows = open_rows.select("n", "key", "pos", "s.near", "s.group").where("group is not null")
    groups = open_rows.groupBy("group", "near").agg(F.count("*").alias("m"), F.min("n").alias("least")).where("m > 1 and least = 1")
    wanted = open_rows.join(groups, ["group", "near"]).select("key", "pos", "group", "near", (F.col("m") > GROUP_ROWS).alias("hot"))
    asked = _unmet_anchors(docs.where(F.octet_length("text") >= 2 * PASSAGE - 1), met.select("key").distinct())
    none = F.lit(None)
    wanted = wanted.union(asked.select("key", "pos", none.cast("long").alias("group"), none.cast("boolean").alias("near"), F.col("met").alias("hot")))
    wanted = stored(wanted, "wanted", CODEC)  # what finds them is off the disk before texts are shuffled
    around = stored(_surroundings(docs, wanted), "strings", CODEC)
    windows = around.where("near is null").select("group", "key", F.col("pos").alias("place"), F.col("hot").alias("met"))
    shared = windows.groupBy("group").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low != high").select("group")
    # documents with settled passages took part as partners only
    passages = met.union(windows.where("not met").join(shared, "group").select("key", "place"))
    strings = around.where("near is not null")
    reach = settled.select("key", F.greatest(F.lit(0), F.col("pos") - STARTS + 1).alias("first"), (F.col("pos") + LENGTH).alias("end"))
    spans = reach.union(_group_spans(strings.where("not hot"))).union(_hot_spans(strings.where("hot")))
    return spans, passages


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows with what is left: ``(doc_id, n_bytes, removed, kept, passages)``.

    Texts are UTF-8 bytes, null is empty. Each byte goes that is covered by a string of LENGTH bytes
    which also starts anywhere else, in any row, in the same one included; all strings are judged on
    the input. ``removed`` holds the maximal runs ``(first, end)``, ``kept`` the bytes that remain.
    Texts shorter than LENGTH keep everything. Rows that are alike are places of their own: from
    LENGTH bytes on, both go whole. A null id is kept as it is. No rows give no rows.

    ``passages`` counts the places where PASSAGE words in a row were found that a row with another id
    or text has, too, 0 if there are none; the words are those between white space, A-Z lower-cased.
    They may have fewer bytes than LENGTH, and then stay.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    keyed = narrow.withColumn("key", F.xxhash64("doc_id", "text"))
    with shuffles_dropped(docs.sparkSession):
        spans, passages = repeated_spans(keyed.select("key", "text"))
        spans = spans.union(passages.select("key", "place", F.lit(-1)))  # an end of -1 marks a passage
        spans = spans.groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("spans"))
        real = F.filter("spans", lambda s: s["end"] >= 0)
        spans = spans.select("key", F.transform(real, lambda s: s["first"]).alias("firsts"), F.transform(real, lambda s: s["end"]).alias("ends"), (F.size("spans") - F.size(real)).cast("long").alias("passages"))
        spans = stored(spans, "spans", CODEC)

    def make(batch):
        for part in _runs(batch):
            counts, removed, kept = [], [], []
            for text, firsts, ends in zip(_bytes(part), part.column("firsts").to_pylist(), part.column("ends").to_pylist()):
                runs, left, at = [], [], 0
                for a, b in sorted((a, min(b, len(text))) for a, b in zip(firsts or [], ends or [])):
                    if runs and a <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], b)
                    else:
                        runs.append([a, b])
                for a, b in runs:
                    left.append(text[at:a])
                    at = b
                counts.append(len(text))
                removed.append([{"first": a, "end": b} for a, b in runs])
                kept.append(b"".join([*left, text[at:]]))
            kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
            columns = [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary()), part.column("passages")]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "removed", "kept", "passages"])

    kind = docs.schema[id_col].dataType.simpleString()
    joined = keyed.join(spans, "key", "left").select("doc_id", "text", "firsts", "ends", F.coalesce("passages", F.lit(0)).alias("passages"))
    return joined.mapInArrow(on_batches(make), f"doc_id {kind}, n_bytes long, removed array<struct<first:int,end:int>>, kept binary, passages long")


def report(cleaned: DataFrame) -> DataFrame:
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["first"]))
    return cleaned.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), F.col("passages").alias("n_passages"))


by_value(__name__)
