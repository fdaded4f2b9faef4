"""The pipeline's stages against brute force, on a small corpus with planted cases."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from flowsift.llm import quality, secrets

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id string, _key string, _rules string, _text string, score string, predicted string, secret_spans string"
OWN = ("own",) * 7
BASE = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def clean(rng, n):
    return " ".join(rng.choice("river stone cloud light field ocean".split()) + str(rng.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    good = [clean(rng, rng.randint(30, 120)) for _ in range(120)]
    items = [(k, clean(rng, 24)) for k in range(3)] + [(7, None), (8, "")]
    texts = list(good)
    for k in range(12):  # copies: as they are, and with one word changed
        words = good[k].split()
        words[len(words) // 2] += "x"
        texts += [good[k], " ".join(words)]
    texts += [f"{clean(rng, 20)} {items[k][1]} {clean(rng, 20)}" for k in range(3)]
    texts += [f"{clean(rng, 25)} api_key = 'abcdef{k}23456' then PASSWORD: {k}zzzzzzzzz {clean(rng, 6)}" for k in range(4)]
    texts += [clean(rng, 2500), None, "", " \n "]
    junk = ["".join(rng.choice("#$%&*@!") for _ in range(200)) + " " + " ".join(["buy"] * 40) for _ in range(60)]
    rows = [(i, t, "en", "s", len(t or ""), *OWN) for i, t in enumerate([*texts, *junk])]
    labels = [(r[0], int(r[0] < len(texts)), 0) for r in rows if r[1] and r[1].strip()]
    folder = f"file://{tmp_path_factory.mktemp('corpus')}"
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, rows, items, len(texts)


def shingles(text, size=5):
    w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def without_copies(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}
    while True:
        before = dict(up)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    up[a] = up[b] = min(up[a], up[b])
        if up == before:
            return [(i, t) for i, t in rows if up[i] == i]


def without_benchmark(rows, items):
    split = lambda t: re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {tuple(w[k : k + 10]) for w in (split(t) for _, t in items) if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    holds = lambda w: any(tuple(w[k : k + m]) in windows for m in sizes for k in range(len(w) - m + 1))
    return [(i, t) for i, t in rows if not holds(split(t))]


def mask(text):
    return text and BASE.sub(lambda m: secrets.MASK if len(m[2]) >= 8 else m[0], text)


def test_stages_against_brute_force(spark, corpus):
    folder, rows, items, n_texts = corpus
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    stages = {name: stage for name, stage in corpus_pipeline.STAGES}
    assert list(stages) == ["quality classifier", "near-dedup", "decontamination", "secret scans", "packing"]

    kept = stages["quality classifier"](spark, documents, folder)
    model = quality.fit(documents, spark.read.parquet(f"{folder}/labels.parquet"))
    want = [(r[0], r[1]) for r in rows if model.scores([r[1] or ""])[0] >= 0.3]
    # whole texts stay and junk goes, those not learned from included
    assert {i for i, t in want if t and t.strip()} == {r[0] for r in rows[:n_texts] if r[1] and r[1].strip()}

    for name, brute in (("quality classifier", lambda x: x), ("near-dedup", without_copies), ("decontamination", lambda x: without_benchmark(x, items)), ("secret scans", lambda x: [(i, mask(t)) for i, t in x])):
        if name != "quality classifier":
            kept = stages[name](spark, kept, folder)
        want = brute(want)
        assert kept.columns == documents.columns
        got = kept.collect()
        assert {r.doc_id: r.text for r in got} == dict(want) and len(got) == len(want)
        assert all(tuple(r)[5:] == OWN and r.n_chars == len(r.text or "") for r in got)
    assert any(t and secrets.MASK in t for _, t in want)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for i, t in want:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        cut = len(ids) % 1024 or 1024
        for piece, start in enumerate([0, *range(cut, len(ids), 1024)]):
            part = ids[start : start + 1024 if piece else cut]
            pieces[i, piece] = (start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    rooms = []
    for size in sorted((p[1] for p in pieces.values()), reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= size
        else:
            rooms.append(1024 - size)
    got = corpus_pipeline.run(spark, folder).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(sequences) == len(rooms)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


def test_stages_on_empty_tables(spark, corpus):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 0")
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, folder)
        assert made.count() == 0
        assert name == "packing" or made.columns == docs.columns


def test_stages_hand_texts_to_python_in_small_batches(spark, monkeypatch):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in bs)
    monkeypatch.setattr(corpus_pipeline.minhash, "without_copies", lambda docs, **_: docs.mapInArrow(sizes, "n long"))
    docs = spark.range(0, 5000, 1, 1)
    try:
        for asked, most in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(name, asked)
            found = [r[0] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
            assert sum(found) == 5000 and max(found) == most
    finally:
        spark.conf.set(name, before)
