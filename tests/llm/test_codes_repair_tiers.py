"""Vector codes, conversation repair and tiered packing against brute force, with nulls, ties, repeats and empty tables."""

import hashlib
import heapq
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from flowsift.llm import codes, repair, tiers

WORDS = public_tokenizers.path("word_bpe_49k.json")


def coded(rows, parts=16, entries=64, rounds=2):
    """Codes of ``(vec_id, vector, label)`` by the plain definition, in whole Python numbers."""
    kept = [(i, [math.floor(256 * v) for v in x], label) for i, x, label in rows if x is not None and all(v is not None and math.isfinite(v) for v in x)]
    out = []
    for size in {len(x) for _, x, _ in kept}:
        own = [r for r in kept if len(r[1]) == size]
        edges = [k * size // parts for k in range(parts + 1)]
        cut = [[tuple(x[a:b]) for a, b in zip(edges, edges[1:])] for _, x, _ in own]
        first = sorted(range(len(own)), key=lambda k: (own[k][0] is None, own[k][0], own[k][1]))[:entries]
        books = [[cut[k][p] for k in first] for p in range(parts)]

        def nearest(part, book):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

        for _ in range(rounds):
            for p, book in enumerate(books):
                groups = {}
                for x in cut:
                    groups.setdefault(nearest(x[p], book)[1], []).append(x[p])
                books[p] = [tuple(sum(c) // len(groups[k]) for c in zip(*groups[k])) if k in groups else e for k, e in enumerate(book)]
        digest = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
        for (i, _, label), x in zip(own, cut):
            found = [nearest(x[p], books[p]) for p in range(parts)]
            out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label, digest))
    sums = {}
    for _, _, error, label, _ in out:
        sums[label] = sums.get(label, 0) + error
    top = 2**63 - 1
    return sorted(((i, code, min(e, top), min(sums[label], top), d) for i, code, e, label, d in out), key=str)


def vectors_of(rng, n, size):
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(9)]
    return [[float(np.float32(c + rng.gauss(0, 0.2))) for c in rng.choice(centres)] for _ in range(n)]


def test_codes_equal_the_plain_definition(spark):
    rng = random.Random(8)
    rows = [(i, v, rng.choice([1, 2, None])) for i, v in enumerate(vectors_of(rng, 220, 32))]
    rows += [(5, rows[7][1], 1), (5, rows[7][1], 1), (None, rows[9][1], 3), (300, None, 1), (301, [1.0] * 31 + [None], 2), (302, [math.nan] * 32, 1), (303, [math.inf] * 32, 1)]
    rows += [(400 + k, [0.25 * k] * 19, 7) for k in range(70)]  # a length of its own that is no multiple of 16
    rows += [(500, [], 1), (501, [0.5] * 5, 1), (502, [0.5] * 5, 1)]
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, size int").repartition(5)
    got = codes.compress(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == coded(rows)
    assert codes.compress(table.where("vec_id < 0")).count() == 0


def test_codes_of_very_large_components(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([1e30, -1e30, 1e305, 3.5, 0.0, 2.0**40]) for _ in range(16)], 1) for i in range(90)]
    rows += [(100 + i, [float(rng.randint(-3, 3)) * 1e7 for _ in range(16)], 2) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted((tuple(r) for r in codes.compress(table).collect()), key=str) == coded(rows)


def test_sliced_search_finds_the_nearest_entry():
    rng = np.random.default_rng(5)
    for spread in (3, 40, 10_000):
        for m in (1, 2, 17, 64):
            book = rng.integers(-spread, spread, (m, 4))
            x = rng.integers(-4 * spread, 4 * spread, (500, 4))
            far = ((x[:, None] - book) ** 2).sum(-1)
            index, distance = codes.Slices(book).nearest(x)
            assert (index == far.argmin(1)).all() and (distance == far.min(1)).all()
    mask = codes.Slices(np.array([[0, 0], [5, 5], [9, 0]])).within(np.array([[4, 4], [9, 9]]), np.array([5, 4]))
    assert mask.tolist() == [0b111, 0b010]


GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def repaired(rows):
    """Counts, cost, audit and turns of one conversation by a search over all edits, cheapest and least first."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        kinds.append("x" if not bare else "d" if (role, text) in seen else "c" if bare[-1] in ".!?" else "t")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    heap, done = [(0, "", 0, 0, ())], set()
    while True:
        cost, audit, at, state, out = heapq.heappop(heap)
        if (at, state) in done:
            continue
        if at == len(rows) and state in (0, 3):
            return (gaps, kinds.count("x"), kinds.count("d"), kinds.count("t"), illegal, cost, audit), out
        done.add((at, state))
        for initial, role in (("u", "user"), ("a", "assistant")):
            if initial in GRAMMAR[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, GRAMMAR[state][initial], (*out, (role, ""))))
        if at < len(rows):
            _, own, text = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, out))
            if kinds[at] in "ct":
                more = 3 * (kinds[at] == "t")
                if own[:1] in GRAMMAR[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, GRAMMAR[state][own[:1]], (*out, (own, text))))
                for initial, role in (("u", "user"), ("a", "assistant")):
                    if initial in GRAMMAR[state]:
                        heapq.heappush(heap, (cost + 3 + more, audit + "R", at + 1, GRAMMAR[state][initial], (*out, (role, text))))


def broken(rows):
    made = {}
    for conv, turn, role, text in rows:
        own = made.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if kind == 1 else text.translate(dict.fromkeys(map(ord, ".!?"))) if kind == 2 else text
        own += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return made


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(6)
    says = ["Yes.", "No!", "Why?  \n", "cut off", "", " \t", "é fin.\x0b", "ok. then ", " "]
    rows = []
    for conv in range(300):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2]
            rows.append((conv, turn + 3 * (rng.random() < 0.1), rng.choice(["system", "tool", "", "User"]) if rng.random() < 0.1 else role, f"{rng.choice(says)}" if rng.random() < 0.4 else f"text {turn}."))
    rows += [(None, 1, "user", "a."), (None, None, None, None), (7, None, "user", "late."), (7, None, "assistant", "x."), (7, 2, None, "y."), (8, 1, "user", None)]
    rows += [(400, 1, "user", "same."), (400, 1, "user", "same."), (400, 1, "user", "other."), (401, 5, "assistant", "z." * 200_000)]
    gone = next(c for c in range(500, 900) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    return rows + [(gone, 0, "user", "all dropped.")]


def test_repair_equals_a_search_over_all_edits(spark, turns):
    table = spark.createDataFrame([(*r, "x", 1) for r in turns], "conv_id long, turn long, role string, text string, digest string, letters int").repartition(3)
    want = {conv: repaired(rows) for conv, rows in broken(turns).items()}
    hurt = repair.damaged(table)
    got = {r[0]: tuple(r)[1:] for r in repair.report(hurt).collect()}
    digests = {c: hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest() for c, (_, out) in want.items()}
    assert got == {c: (*facts, digests[c]) for c, (facts, _) in want.items()}
    texts = {}
    for r in repair.repair(hurt).orderBy("conv_id", "position").collect():
        assert r.position == len(texts.setdefault(r.conv_id, []))
        texts[r.conv_id].append((r.role, r.text))
    assert texts == {c: list(out) for c, (_, out) in want.items() if out}
    assert repair.report(repair.damaged(table.where("conv_id < 0"))).count() == 0


def test_endings_are_worked_out_once():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("aabbcdefghi") for _ in range(rng.randint(0, 6))) for _ in range(400)})
    endings = repair.Endings()
    found = {w: endings.solve(w) for w in words}
    assert endings.made == len({w[:k] for w in words for k in range(len(w) + 1)} | {""})
    assert all(found[w] == repair.Endings().solve(w) for w in words)


def test_long_conversation(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"says {t}.") for t in range(30_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (r,) = repair.report(repair.damaged(table)).collect()
    assert len(r.audit) >= sum(len(x) for x in broken(rows).values()) and r.gaps > 1000


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(2)
    word = lambda: rng.choice("Alpha beta's gamma, délta. 12.5 don't é. İstanbul Σας x² <|endoftext|> áb ́ 中文字 «ok»! ...and 'll".split(" "))
    made = [" ".join(word() for _ in range(rng.choice([1, 5, 40, 300, 900]))) for _ in range(120)]
    return [*made, made[3], made[3], None, "", " \n\t", "a" * 5000, "x y z\x85w\x1cq", made[0] * 30]


def test_tiers_hold_every_id_once_without_padding(spark, texts):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1), (None, "no id", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string, context int").repartition(4)
    got = tiers.pack_documents(docs, WORDS, step_tokens=1 << 13).collect()
    tokenizer = Tokenizer.from_file(WORDS)
    pieces, windows = {}, {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append(r)
        assert len(r.ids) == 2 * r.length and zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) == r.ids_crc32
    for i, text in dict((r[0], r[1]) for r in rows).items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        times = sum(r[0] == i for r in rows)
        held = sorted((r.start, r.start + r.length) for r in pieces[i])
        assert sum(b - a for a, b in held) == times * len(ids) and {r.doc_tokens for r in pieces[i]} == {len(ids)}
        for r in pieces[i]:
            assert np.frombuffer(r.ids, "<u2").tolist() == ids[r.start : r.start + r.length]
        if times == 1:
            assert [a for a, _ in held] == [0, *(b for _, b in held[:-1])]
    groups = {}
    for parts in windows.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].context and at & (at - 1) == 0 and at <= 2048
        groups.setdefault(parts[0].context, {}).setdefault(parts[0].step_group, []).append(at)
    for sizes in groups.values():
        many = [len(v) for v in sizes.values()]
        assert max(many) - min(many) <= 1 and all(sum(v) <= 1 << 13 for v in sizes.values())
    assert tiers.pack_documents(docs.where("doc_id < 0"), WORDS).count() == 0


def test_chunks_keep_the_tokenizers_ids():
    tokenizer = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    parts = ["a", "Be", "é", "ß", "×", "÷", "ñ", "ȿ", "Ā", "'s", "'", "'re", "|", "<|endoftext|>", "<|startoftext|>", "<", ">", ".", "***", "#", "&", "1", "23", " ", "\n", "\xa0", "\u0301", "中", "😀", "İ", "Σ", "\u200d", "_", "½", "²", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    ids, counts = tiers.Encoder(WORDS).encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert got.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)


def test_tier_plans_are_gapless_and_short():
    rng = random.Random(1)
    for _ in range(150):
        lengths = {rng.randint(1, 2048): rng.randint(1, rng.choice([1, 3, 50])) for _ in range(rng.randint(1, rng.choice([2, 10, 200])))}
        made = tiers.plan(lengths)
        assert sum(size * n for size, _, n in made.tiers) == sum(size * n for size, n in lengths.items())
        length = np.repeat(list(lengths), list(lengths.values()))
        rank = np.concatenate([np.arange(n) for n in lengths.values()])
        places = tiers.Places(made, 1 << 14)
        row, first, tokens, window, offset = places.find(length, rank)
        context, _ = places.group(window)
        for key, begin, size in ((window, offset, context), (row, first, length[row])):
            order = np.lexsort((begin, key))
            same = np.diff(key[order]) == 0
            ends = (begin + tokens)[order]
            assert (begin[order] == np.concatenate([[0], np.where(same, ends[:-1], 0)])).all()
            last = np.append(~same, True)
            assert (ends[last] == size[order][last]).all()
    many = tiers.plan({n: rng.randint(1, 10**9) for n in range(1, 2049)})
    assert len(many.whole) < 20_000 and len(many.cut) < 1000


def test_long_windows_take_from_shorter_tiers():
    steps = tiers.fill({1500: 10, 500: 10, 48: 10, 200: 40})
    assert steps[0] == tiers.Step(2048, 0, 10, [(1500, 1, 0), (500, 1, 0), (48, 1, 0)])
    assert all(s.context == 256 for s in steps[1:])
