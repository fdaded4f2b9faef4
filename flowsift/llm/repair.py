"""Repair of conversation structure: cheapest edits, worked out once per shared ending of all conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from flowsift.llm.common import by_value, stored

# Edits with their costs, and the grammar ``(s?(ua)+)?`` of role initials.
DELETE, INSERT, KEEP, REROLE = "DIKR"
COSTS = {DELETE: 4, INSERT: 3, KEEP: 0, REROLE: 3}
TRUNCATED = 3
ROLES = {"u": "user", "a": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
#: states a role initial leads to, and those in which a conversation may end
STEPS = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
ENDS = {START, ASSISTANT}
#: what follows an inserted or renamed turn, which is the user's or the assistant's
MADE = {state: next(r for r in "ua" if r in steps) for state, steps in STEPS.items()}
NEVER = 1 << 60
WHITE = "\t\n\x0b\x0c\r "


class Endings:
    """An automaton of row signatures, shared from the end.

    A signature has a letter per row. A node stands for an ending that signatures have in common:
    the letter before it leads to the next longer one. Signatures come sorted by their letters
    from the last to the first, so the ending that one shares with the signature before it is
    there already, and each node is made once; those off the path are done with and dropped.
    ``cost[d][state]`` is the least cost of all edits in the last ``d`` rows from a grammar state
    on, ``move`` the first of these edits, ``D`` before ``I`` before ``K`` before ``R`` if several
    cost the same. The best audit of an ending is its first edit and the best audit after that.
    """

    def __init__(self):
        self.letters: list[str] = []
        self.cost: list[tuple[int, ...]] = []
        self.move: list[tuple[str, ...]] = []
        self.made = 0
        self._node(tuple((0, "") if state in ENDS else (NEVER, "") for state in STEPS))

    def _node(self, best: tuple[tuple[int, str], ...]) -> None:
        """One or two inserted turns may come before what follows; a third is never cheaper."""
        once = [min(best[s], (best[STEPS[s][MADE[s]]][0] + COSTS[INSERT], INSERT)) for s in STEPS]
        twice = [min(best[s], (once[STEPS[s][MADE[s]]][0] + COSTS[INSERT], INSERT)) for s in STEPS]
        self.cost.append(tuple(c for c, _ in twice))
        self.move.append(tuple(m for _, m in twice))
        self.made += 1

    def _lengthen(self, letter: str) -> None:
        after = self.cost[-1]
        best = []
        role, kind = letter
        extra = TRUNCATED if kind == "t" else 0
        for state, steps in STEPS.items():
            ways = [(after[state] + COSTS[DELETE], DELETE)]
            if kind != "x":
                if role in steps:
                    ways.append((after[steps[role]] + COSTS[KEEP] + extra, KEEP))
                ways.append((after[steps[MADE[state]]] + COSTS[REROLE] + extra, REROLE))
            best.append(min(ways))
        self.letters.append(letter)
        self._node(tuple(best))

    def solve(self, backwards: str) -> tuple[int, str]:
        """Cost and audit of a signature given from its last letter on."""
        rows = [LETTERS[c] for c in backwards]
        same = 0
        while same < min(len(rows), len(self.letters)) and rows[same] == self.letters[same]:
            same += 1
        del self.letters[same:], self.cost[same + 1 :], self.move[same + 1 :]
        for letter in rows[same:]:
            self._lengthen(letter)
        left, state, audit = len(rows), START, []
        cost = self.cost[left][state]
        while edit := self.move[left][state]:
            audit.append(edit)
            if edit == KEEP:
                state = STEPS[state][rows[left - 1][0]]
            elif edit != DELETE:
                state = STEPS[state][MADE[state]]
            left -= edit != INSERT
        return cost, "".join(audit)


#: letters of a signature: a row's role initial (o: any other) and whether it is clean, truncated or to be deleted
LETTERS = {chr(97 + k): pair for k, pair in enumerate([*(r + t for t in "ct" for r in "suao"), "ox"])}
NAMES = {pair: letter for letter, pair in LETTERS.items()}


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, gone)``: rows damaged by a checksum of conversation and turn; nulls are one space.

    One row in twenty each is dropped (it stays here, as ``gone``), emptied, robbed of its ``.!?``,
    repeated, or given the role user.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(shown(conv), F.lit(":"), shown(turn))) % 20
    rows = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), shown(role).alias("role"),
        shown(text).alias("text"), kind.alias("kind"), F.explode(F.sequence(F.lit(0), F.when(kind == 3, 1).otherwise(0))).alias("copy"),
    )
    return rows.select(
        "conv_id", "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("gone"),
    )


#: the order of a conversation's rows; nulls come first
ORDER = ["turn", "role", "digest"]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(column.to_pylist() for column in batch.columns))


def _write(rows: Iterator[tuple], schema: list[tuple[str, pa.DataType]], many: int = 5000, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of a bounded number and of about ``most`` characters."""

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*held), schema)], [name for name, _ in schema])

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) == many or size >= most:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


class Facts:
    """What one conversation's rows say, taken up in their order."""

    def __init__(self):
        self.letters: list[str] = []
        self.low = self.high = self.before = None
        self.turns = self.illegal = 0
        self.faults = dict.fromkeys("xdtc", 0)

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn
        self.faults[fault] += 1
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        self.letters.append(NAMES["ox" if fault in "xd" else initial + fault])

    def row(self, conv: int | None) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        counts = (gaps, self.faults["x"], self.faults["d"], self.faults["t"], self.illegal)
        return conv, "".join(reversed(self.letters)), *counts


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def signatures(rows: DataFrame) -> DataFrame:
    """``(conv_id, letters, gaps, blank, duplicate, truncated, illegal)`` per conversation, the letters from the last row on.

    Turn, role, flags and a digest of each text are shuffled, no texts. A task holds a letter for
    each row of one conversation at a time.
    """
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    kind = F.when(end == "", "x").when(F.right(end, F.lit(1)).isin(".", "!", "?"), "c").otherwise("t")
    narrow = rows.select("conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), kind.alias("kind"), "gone").repartition("conv_id")
    alike = Window.partitionBy("conv_id", "role", "digest", "gone").orderBy(F.col("turn").asc_nulls_first())
    seen = narrow.withColumn("kind", F.when((F.col("kind") != "x") & (F.row_number().over(alike) > 1), "d").otherwise(F.col("kind")))
    initial = F.substring("role", 1, 1)
    ordered = seen.sortWithinPartitions("conv_id", *ORDER).select(
        "conv_id", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("initial"), "kind", "gone"
    )

    def run(batches):
        def made():
            facts, current = None, None
            for conv, turn, initial, kind, gone in _read(batches):
                if facts is None or conv != current:
                    if facts:
                        yield facts.row(current)
                    facts, current = Facts(), conv
                if not gone:
                    facts.add(turn, initial, kind)
            if facts:
                yield facts.row(current)

        yield from _write(made(), [("conv_id", pa.int64()), ("letters", pa.string()), *((c, pa.int64()) for c in COUNTS)])

    return ordered.mapInArrow(run, "conv_id long, letters string, " + ", ".join(f"{c} long" for c in COUNTS))


def audits(signed: DataFrame) -> DataFrame:
    """``(conv_id, audit, cost, gaps, ...)``: the cheapest edits of every conversation.

    Signatures are dealt and sorted by their letters from the end, so those with a common ending
    are neighbours, and a signature that many conversations have is split by their ids.
    """
    columns = ["letters", "conv_id", *COUNTS]

    def run(batches):
        def made():
            endings, last, found = Endings(), None, (0, "")
            for letters, conv, *counts in _read(batches):
                if letters != last:
                    last, found = letters, endings.solve(letters)
                yield conv, found[1], found[0], *counts

        yield from _write(made(), [("conv_id", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), *((c, pa.int64()) for c in COUNTS)])

    dealt = signed.select(*columns).repartitionByRange("letters", "conv_id").sortWithinPartitions("letters", "conv_id")
    return dealt.mapInArrow(run, "conv_id long, audit string, cost long, " + ", ".join(f"{c} long" for c in COUNTS))


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Repaired conversations from their audits, each before its rows: a head, and then its turns."""

    def inserted():
        nonlocal at, state, place
        while at < len(audit) and audit[at] == INSERT:
            role = MADE[state]
            state, at, place = STEPS[state][role], at + 1, place + 1
            yield conv, place - 1, ROLES[role], "", INSERT, None

    conv, audit, at, state, place = None, "", 0, START, 0
    for key, is_row, role, text, counts in rows:
        if not is_row:
            yield from inserted()
            conv, audit, at, state, place = key, text, 0, START, 0
            yield conv, -1, None, audit, None, counts
            continue
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit == DELETE:
            continue
        made = MADE[state] if edit == REROLE else role[0]
        state, place = STEPS[state][made], place + 1
        yield conv, place - 1, ROLES[made] if edit == REROLE else role, text, edit, None
    yield from inserted()


def _edited(turns: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text, edit, counts)``, conversation after conversation in each partition.

    A conversation's head has position -1, its audit as ``text`` and ``counts``; its turns follow.
    Texts are shuffled once, to where their conversation's audit is.
    """
    solved = stored(audits(stored(signatures(turns), "signatures")), "audits")
    none = F.lit(None)
    heads = solved.select("conv_id", F.lit(False).alias("is_row"), none.cast("long").alias("turn"), none.cast("string").alias("role"), F.col("audit").alias("text"), none.cast("binary").alias("digest"), F.array(*COUNTS, "cost").alias("counts"))
    rows = turns.where("not gone").select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "text", F.unhex(F.sha2("text", 256)).alias("digest"), none.cast("array<long>").alias("counts"))
    ordered = heads.union(rows).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", *ORDER).select("conv_id", "is_row", "role", "text", "counts")

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64())]
        yield from _write(edited(_read(batches)), list(zip(["conv_id", "position", "role", "text", "edit", "counts"], kinds)))

    return ordered.mapInArrow(run, "conv_id long, position long, role string, text string, edit string, counts array<long>")


def repair(turns: DataFrame) -> DataFrame:
    """``(conv_id, position, role, text, edit)``: the turns of all conversations after their cheapest edits.

    ``turns`` has ``(conv_id, turn, role, text, gone)``, without nulls in role, text and ``gone``; rows
    that are gone only name their conversation. Rows are taken by turn, those without one first;
    rows of one turn by role and then by a digest of the text, so that alike rows are neighbours. A
    row's first fault counts: blank, duplicate (role and text of a row before it), truncated (its
    last sign isn't one of ``.!?``). Kept turns cost nothing, a changed role or an inserted turn 3,
    a deleted one 4, and a truncated one that stays 3 more; blank and duplicate ones are deleted.
    Roles then begin with ``s`` or not, and alternate between ``u`` and ``a``, ending with ``a``.
    Conversations without rows, or whose rows are all deleted, have none here. A null id is a
    conversation. No rows give no rows.
    """
    return _edited(turns).where("position >= 0").drop("counts")


def report(turns: DataFrame) -> DataFrame:
    """Per conversation its counts, the cost and audit of its repair, and a digest of the repaired turns."""

    def run(batches):
        def made():
            head, hashed = None, None
            for conv, position, role, text, _, counts in _read(batches):
                if position < 0:
                    if head:
                        yield *head, hashed.hexdigest()
                    head, hashed = (conv, *counts, text), hashlib.sha256()
                else:
                    hashed.update(("\n" * (position > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            if head:
                yield *head, hashed.hexdigest()

        kinds = [("conv_id", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())]
        yield from _write(made(), kinds)

    schema = "conv_id long, " + ", ".join(f"{c} long" for c in (*COUNTS, "cost")) + ", audit string, repaired_sha256 string"
    return _edited(turns).mapInArrow(run, schema)


by_value(__name__)
