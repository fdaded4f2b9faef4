"""Packing into windows of several context sizes: tiers, gaps filled from shorter tiers, step groups."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowsift.llm.common import by_value, on_batches, stored, text_batches
from flowsift.llm.grams import SOLID, VALUES, span_hashes

#: window sizes, each a power of two; a document's tier is the least window that holds it
CONTEXTS = (2048, 1024, 512, 256)
#: tokens of a step group
STEP_TOKENS = 1 << 16
END_ID = 1
#: slots for chunks that a task remembers, ids it keeps for them, and the bytes of the longest of them
SLOTS = 1 << 20
POOL = 1 << 23
LONG_CHUNK = 96
#: ASCII signs that are neither in contractions nor in the added tokens of usual vocabularies
SIGNS = np.zeros(256, bool)
SIGNS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'|"]] = True
#: ASCII letters and digits
PLAIN = np.zeros(256, bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True
#: lead bytes of the letters from U+00C0 to U+023F, but for two signs, and U+0130, whose lower case ends in a mark
LEADS = np.zeros(256, bool)
LEADS[0xC3:0xC9] = True
#: runs of the same letters: one word whatever is around it
WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u023f]+")
_made: dict = {}


def byte_signs() -> dict[int, int]:
    """The published byte-level alphabet: printable Latin-1 characters stand for their byte, others come from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: b if b in shown else 256 + k for k, b in enumerate([*(b for b in range(256) if b not in shown), *shown])}


def chunks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks of UTF-8 bytes begin and end: runs of signs and of letters, cut where that is sure.

    Chunks end at ASCII white space, and where an ASCII sign meets a letter or digit before it, or
    an ASCII letter or digit behind it. Apostrophes and bars don't cut: they may belong to a
    contraction or an added token.
    """
    solid = SOLID[data]
    sign, plain = SIGNS[data], PLAIN[data]
    letter = plain.copy()
    tail = LEADS[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
    letter[1:] |= tail & ~((data[:-1] == 0xC4) & (data[1:] == 0xB0))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | (sign[1:] & letter[:-1]) | (plain[1:] & sign[:-1])
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | begins[1:]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


class Encoder:
    """Token ids of many texts for a tokenizer that drops white space and never joins across it.

    Texts are cut into chunks that no token, normal form or added token of such a tokenizer reaches
    across. Ids of chunks met before are looked up by hash, a slot holds the last chunk of its hash;
    new and long ones go through the tokenizer. The table changes the time only; a full pool is begun anew.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.signs = byte_signs()
        letters = [chr(c) for c in range(0x240) if WORD.fullmatch(chr(c))]
        words = [*letters, *(a + b for a, b in zip(letters, letters[1:])), "".join(letters[:80])]
        self.direct = all(self._word(w) == self.tokenizer.encode(w, add_special_tokens=False).ids for w in words)
        self.clear()

    def _word(self, word: str) -> list[int]:
        """Ids of a word of Latin letters, where the tokenizer lower-cases and is a byte-level one."""
        return [t.id for t in self.tokenizer.model.tokenize(word.lower().encode().decode("latin-1").translate(self.signs))]

    def clear(self) -> None:
        self.keys = np.zeros(SLOTS, np.uint64)
        self.at, self.count = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places in the pool and numbers of ids of new chunks."""
        direct = [bool(self.direct and WORD.fullmatch(p)) for p in pieces]
        words = [self._word(p) for p, d in zip(pieces, direct) if d]
        made = self.tokenizer.encode([p for p, d in zip(pieces, direct) if not d], is_pretokenized=True, add_special_tokens=False)
        direct = np.array(direct)
        counts = np.empty(len(pieces), np.int64)
        counts[direct] = [len(w) for w in words]
        counts[~direct] = np.bincount(np.array(made.word_ids, np.int64), minlength=int((~direct).sum()))
        total = int(counts.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        own = np.repeat(direct, counts)
        new = self.pool[self.used : self.used + total]
        new[own], new[~own] = list(chain.from_iterable(words)), made.ids
        places = self.used + np.cumsum(counts) - counts
        self.used += total
        return places, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the number of ids of each text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        blob = b" ".join([*raw, b""])
        data = np.frombuffer(blob, np.uint8)
        starts, ends = chunks(data)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if self.used > POOL:
            self.clear()
        names = span_hashes(VALUES[data], starts, ends) | np.uint64(1)
        slots = (names >> np.uint64(44)).astype(np.int64)
        long = ends - starts > LONG_CHUNK
        at, counts = self.at[slots], self.count[slots]
        unknown = np.flatnonzero((self.keys[slots] != names) & ~long)
        long = np.flatnonzero(long)
        _, one, back = np.unique(names[unknown], return_index=True, return_inverse=True)
        new = unknown[one]
        asked = np.concatenate([new, long])
        if len(asked):
            places, sizes = self._learn([blob[a:b].decode("utf-8", "replace") for a, b in zip(starts[asked].tolist(), ends[asked].tolist())])
            at[unknown], counts[unknown] = places[: len(new)][back], sizes[: len(new)][back]
            at[long], counts[long] = places[len(new) :], sizes[len(new) :]
            last = np.unique(slots[new][::-1], return_index=True)[1]
            last = len(new) - 1 - last
            self.keys[slots[new[last]]], self.at[slots[new[last]]], self.count[slots[new[last]]] = names[new[last]], places[last], sizes[last]
        shift = np.cumsum(counts) - counts
        ids = self.pool[np.arange(int(counts.sum())) + np.repeat(at - shift, counts)]
        done = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
        return ids, np.diff(done[np.searchsorted(starts, bounds)])


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _made:
        _made[vocabulary] = Encoder(vocabulary)
    return _made[vocabulary]


def _kind(vocabulary: str) -> str:
    return "<u2" if _encoder(vocabulary).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, id_col: str, text: str | Column, vocabulary: str, window: int, end_id: int = END_ID) -> DataFrame:
    """``(doc_id, start, length, doc_tokens, ids_crc32, ids)``: each document in pieces of ``window`` tokens and a rest.

    A document is its ids and the end id. ``ids`` are little-endian unsigned numbers, of 16 bits in
    vocabularies that fit, else of 32; ``ids_crc32`` is that of 32-bit numbers.
    """
    kind = _kind(vocabulary)

    def make(batch):
        encoder = _encoder(vocabulary)
        names = batch.column("doc_id").to_pylist()
        for first, texts in text_batches(batch, "text", 2_000_000):
            ids, counts = encoder.encode(texts)
            at = 0
            out: list[list] = [[] for _ in range(6)]
            for row, n in enumerate(counts.tolist(), first):
                own = np.append(ids[at : at + n], end_id).astype("<u4")
                at += n
                for start in range(0, n + 1, window):
                    part = own[start : start + window]
                    for column, value in zip(out, (names[row], start, len(part), n + 1, zlib.crc32(part.tobytes()), part.astype(kind).tobytes())):
                        column.append(value)
            types = [*[pa.int64()] * 5, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "start", "length", "doc_tokens", "ids_crc32", "ids"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    return narrow.mapInArrow(on_batches(make), "doc_id long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


@dataclass
class Plan:
    """Where the pieces of each length go, by their rank among those of it.

    ``whole`` has runs ``(length, first rank, pieces, pieces per window, first window, offset)``.
    ``cut`` has runs ``(length, first rank, pieces, first place)`` of pieces laid end to end as one
    stream of tokens, and ``gaps`` the places of the stream in windows: ``(first place, size, gaps,
    first window, offset)``. ``tiers`` are ``(context, first window, windows)``.
    """

    whole: list[tuple[int, ...]]
    cut: list[tuple[int, ...]]
    gaps: list[tuple[int, ...]]
    tiers: list[tuple[int, int, int]]


@dataclass
class Step:
    """Windows filled alike: ``parts`` are ``(length, pieces per window, first rank)``."""

    context: int
    gap: int
    windows: int
    parts: list[tuple[int, int, int]]


def fill(lengths: dict[int, int], contexts: tuple[int, ...] = CONTEXTS) -> list[Step]:
    """Whole pieces in windows of their tier, the least context that holds them.

    Tiers come from the longest: the longest waiting piece opens a window, and its gap takes the
    longest waiting pieces that fit, which are of shorter tiers. Pieces of a length are alike, so a
    step fills as many windows as all the lengths in it allow.
    """
    count, placed = {n: k for n, k in lengths.items() if k}, dict.fromkeys(lengths, 0)
    held = sum(1 << n for n in count)  # bit n: pieces of length n wait
    steps = []
    for context, below in zip(contexts, (*contexts[1:], 0)):
        while (size := (held & (1 << (context + 1)) - 1).bit_length() - 1) > below:
            gap, parts, n = context, [], size
            while n > 0:
                per = min(gap // n, count[n])
                parts.append((n, per, placed[n]))
                gap -= per * n
                n = (held & (1 << min(gap + 1, n)) - 1).bit_length() - 1
            windows = min(count[n] // per for n, per, _ in parts)
            for n, per, _ in parts:
                count[n] -= per * windows
                placed[n] += per * windows
                if not count[n]:
                    held &= ~(1 << n)
            steps.append(Step(context, gap, windows, parts))
    return steps


def plan(lengths: dict[int, int], contexts: tuple[int, ...] = CONTEXTS) -> Plan:
    """Windows without any room left.

    What ``fill`` leaves open takes pieces that are cut: windows with a gap are given up, those of
    the shortest tier and with the largest gaps first, until their tokens, laid end to end, fill all
    other gaps. The tokens beyond that get windows of the longest context, and powers of two at last.
    """
    steps = fill(lengths, contexts)
    open_tokens, free, stream = sum(s.gap * s.windows for s in steps), 0, []
    for step in sorted((s for s in steps if s.gap), key=lambda s: (s.context, -s.gap)):
        many = min(step.windows, -(-max(0, open_tokens - free) // step.context))
        step.windows -= many
        open_tokens -= many * step.gap
        free += many * (step.context - step.gap)
        stream += [(n, first + per * step.windows, per * many) for n, per, first in step.parts if many]
    beyond = free - open_tokens
    tail = {contexts[0]: beyond // contexts[0]} | {1 << k: beyond >> k & 1 for k in reversed(range(contexts[0].bit_length() - 1))}
    made, tiers, opened, gaps = Plan([], [], [], []), [], 0, []
    for context in sorted({*contexts, *(c for c, n in tail.items() if n)}, reverse=True):
        begun = opened
        for step in (s for s in steps if s.context == context and s.windows):
            at = 0
            for n, per, first in step.parts:
                made.whole.append((n, first, per * step.windows, per, opened, at))
                at += per * n
            if step.gap:
                gaps.append((step.gap, step.windows, opened, at))
            opened += step.windows
        if tail.get(context):
            gaps.append((context, tail[context], opened, 0))
            opened += tail[context]
        if opened > begun:
            tiers.append((context, begun, opened - begun))
    place = 0
    for n, first, pieces in sorted(stream, reverse=True):
        made.cut.append((n, first, pieces, place))
        place += n * pieces
    place = 0
    for size, many, first, at in sorted(gaps, reverse=True):
        made.gaps.append((place, size, many, first, at))
        place += size * many
    made.tiers = tiers
    return made


class Places:
    """A plan as arrays: the places of many pieces at once."""

    def __init__(self, made: Plan, step_tokens: int):
        runs = [(*r[:2], 1, *r[3:]) for r in made.whole] + [(n, first, 0, place, 0, 0) for n, first, _, place in made.cut]
        self.stride = max((r[1] + r[2] for r in (*made.whole, *made.cut)), default=0) + 1
        runs = np.array(runs, np.int64).reshape(-1, 6)
        self.runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
        self.begin = self.runs[:, 0] * self.stride + self.runs[:, 1]
        self.gaps = np.array(made.gaps, np.int64).reshape(-1, 5)
        self.units = np.cumsum(self.gaps[:, 2]) - self.gaps[:, 2]
        self.size, self.first, windows = np.array(made.tiers, np.int64).reshape(-1, 3).T
        self.groups = -(-windows * self.size // step_tokens)
        self.before = np.cumsum(self.groups) - self.groups

    def unit(self, place: np.ndarray) -> np.ndarray:
        """The number of the gap that has a place of the stream."""
        run = np.searchsorted(self.gaps[:, 0], place, "right") - 1
        return self.units[run] + (place - self.gaps[run, 0]) // self.gaps[run, 1]

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """``(row, first token, tokens, window, offset)``, one or more per row."""
        run = self.runs[np.searchsorted(self.begin, length * self.stride + rank, "right") - 1]
        nth, whole = rank - run[:, 1], run[:, 2] == 1
        per = np.where(whole, run[:, 3], 1)
        found = [(np.flatnonzero(whole), *(a[whole] for a in (np.zeros_like(length), length, run[:, 4] + nth // per, run[:, 5] + nth % per * length)))]
        rows = np.flatnonzero(~whole)
        if len(rows):
            begin = run[rows, 3] + nth[rows] * length[rows]
            low, high = self.unit(begin), self.unit(begin + length[rows] - 1)
            times = high - low + 1
            row = np.repeat(np.arange(len(rows)), times)
            unit = np.repeat(low, times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            gap = self.gaps[at := np.searchsorted(self.units, unit, "right") - 1]
            nth = unit - self.units[at]
            opens = gap[:, 0] + nth * gap[:, 1]
            start, end = np.maximum(opens, begin[row]), np.minimum(opens + gap[:, 1], (begin + length[rows])[row])
            found.append((rows[row], start - begin[row], end - start, gap[:, 3] + nth, gap[:, 4] + start - opens))
        return tuple(np.concatenate(c) for c in zip(*found))

    def group(self, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Context and step group of windows."""
        tier = np.searchsorted(self.first, window, "right") - 1
        return self.size[tier], self.before[tier] + (window - self.first[tier]) % self.groups[tier]


def pack(pieces: DataFrame, contexts: tuple[int, ...] = CONTEXTS, step_tokens: int = STEP_TOKENS, kind: str = "<u4") -> DataFrame:
    """``pieces`` cut and placed: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group, ids)``.

    ``ids`` are numbers of the numpy type ``kind``.

    Only the number of pieces of each length, at most the longest context's, comes to the driver;
    the plan that goes back depends on the lengths and hardly on how often they occur. Ranks within a
    length are counted in shards by a hash of the row, so no length, however frequent, is in one
    task. Equal rows differ only in their rank. No rows give no rows.
    """
    keys = ["doc_id", "start", "ids_crc32"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group long, ids binary"
    shards = max(8, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sharded = pieces.withColumn("_shard", F.pmod(F.xxhash64(*keys), F.lit(shards)))
    counts = stored(sharded.groupBy("_shard", "length").agg(F.count("*").alias("_n")), "lengths")
    places = Places(plan({r[0]: r[1] for r in counts.groupBy("length").agg(F.sum("_n")).collect()}, contexts), step_tokens)
    window = Window.partitionBy("length").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(window), F.lit(0))).drop("_n")
    ranked = sharded.withColumn("_rank", F.row_number().over(Window.partitionBy("_shard", "length").orderBy(*keys)) - 1)
    ranked = ranked.join(base, ["_shard", "length"]).select(*pieces.columns, (F.col("_rank") + F.col("_base")).alias("_rank"))

    def place(batch):
        rank, length, start = (batch.column(c).to_numpy().astype(np.int64) for c in ("_rank", "length", "start"))
        row, first, tokens, sequence, offset = places.find(length, rank)
        context, group = places.group(sequence)
        raw, crcs, width = batch.column("ids"), batch.column("ids_crc32").to_numpy()[row].tolist(), np.dtype(kind).itemsize
        parts = [raw[r].as_py() for r in row.tolist()]
        for k in np.flatnonzero(tokens != length[row]).tolist():  # pieces that are cut
            parts[k] = parts[k][width * int(first[k]) : width * int(first[k] + tokens[k])]
            crcs[k] = zlib.crc32(np.frombuffer(parts[k], kind).astype("<u4").tobytes())
        own = batch.select(["doc_id", "doc_tokens"]).take(pa.array(row))
        columns = [
            own.column("doc_id"), pa.array(start[row] + first), pa.array(tokens), pa.array(crcs, pa.int64()),
            own.column("doc_tokens"), pa.array(sequence), pa.array(offset), pa.array(context.astype(np.int32)), pa.array(group), pa.array(parts, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return ranked.mapInArrow(on_batches(place), schema)


def pack_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text", contexts: tuple[int, ...] = CONTEXTS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents in windows of several context sizes; every id is in one piece.

    Documents, null and empty ones as the end id alone, are cut where they fill a window: into
    windows of the longest context, and by their head where a gap is left. Every window holds as
    many tokens as its ``context`` says. ``step_group`` deals the windows of a context by turns to
    groups of at most ``step_tokens`` tokens, which differ by one window at most; windows that
    follow each other were filled alike, so groups are alike in their pieces too. Rows that are
    alike, and rows of one id, are packed each by itself. No rows give no rows.
    """
    pieces = stored(tokenized(docs, id_col, text, vocabulary, contexts[0]), "pieces")
    return pack(pieces, contexts, step_tokens, _kind(vocabulary))


def report(packed: DataFrame) -> DataFrame:
    return packed.drop("ids")


by_value(__name__)
