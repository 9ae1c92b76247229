"""Decontamination against alignment of every item with every text, and of benchmarks whose items share a phrase."""

import random
import time

import numpy as np
import pytest

from quizforge.llm import decontaminate, queries

SF = "/root/testdata/sf0.001"


def plain(text):
    raw = np.frombuffer((text or "").encode(), np.uint8)
    return decontaminate.normalised(raw, np.array([0, len(raw)]))[0]


def ends_of(item, text):
    """The fewest edits of ``item`` at each end in ``text``, by the whole table of an alignment."""
    row, at = np.zeros(len(text) + 1, np.int32), np.arange(len(text) + 1, dtype=np.int32)
    for i, c in enumerate(item.tolist(), 1):
        new = np.minimum(row + 1, np.concatenate(([i], row[:-1] + (text != c))))
        row = (np.minimum.accumulate(new - at) + at).astype(np.int32)
    return row


def budget(n):
    return min(n // 10, n // (8 if n >= 40 else 4) - 1)


def brute(texts, items):
    """{(document, item): edits} of all items of 8 bytes or more, over all texts at once: a byte that no item has parts them."""
    bodies = [plain(t) for t in texts]
    gap = np.full(400, 255, np.uint8)
    whole = np.concatenate([x for b in bodies for x in (b, gap)])
    first = np.cumsum([0, *(len(b) + len(gap) for b in bodies)])
    found = {}
    for i, t in enumerate(items):
        item = plain((t or "").strip())
        if len(item) < 8:
            continue
        least = np.minimum.reduceat(ends_of(item, whole), first[:-1])
        found |= {(d, i): int(least[d]) for d in np.flatnonzero(least <= budget(len(item))).tolist()}
    return found


def test_query_against_every_alignment(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    assert max(len(plain(r.text)) for r in items) < 4000
    want = brute([r.text for r in docs], [r.text for r in items])
    got = queries.op3_decontaminate(spark, SF).collect()
    assert {(r.doc_id, r.item_id): r.edits for r in got} == {(docs[d].doc_id, items[i].item_id): e for (d, i), e in want.items()} and want


def edited(rng, text, n):
    s = list(text)
    for _ in range(n):
        p, kind = rng.randrange(len(s)), rng.randrange(3)
        s[p : p + 1] = {0: [rng.choice("abcd")], 1: [s[p], rng.choice("abcd")], 2: []}[kind] or ([] if len(s) > 5 else [s[p]])
    return "".join(s)


@pytest.mark.parametrize("seed, postings, regions", [(1, 1 << 21, 1 << 14), (2, 500, 16), (3, 5, 1)])
def test_items_that_share_a_phrase_against_every_alignment(monkeypatch, seed, postings, regions):
    monkeypatch.setattr(decontaminate, "POSTINGS", postings)
    monkeypatch.setattr(decontaminate, "REGIONS", regions)
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    for n in (12, 45, 64, 70, 130, 320, 700):
        shared = some(n // 2)
        items = [shared + some(n // 2 + rng.randrange(6)) for _ in range(9)] + [some(n)]
        texts = [some(rng.randrange(60)) + edited(rng, rng.choice(items), rng.randrange(1 + n // 8)) + some(rng.randrange(60)) + shared for _ in range(7)] + ["", shared * 3]
        raw = [t.encode() for t in texts]
        found = decontaminate.matches(decontaminate.Block(list(range(10)), items, 0.1), np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        assert {(d, i): e for d, i, e, _ in found} == brute(texts, items)
        for d, i, e, end in found:
            assert ends_of(plain(items[i].strip()), plain(texts[d].encode()[:end].decode()))[-1] == e


def test_thousands_of_items_that_share_a_phrase():
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    words = lambda n: " ".join(word() for _ in range(n))
    shared = "Which of the following statements best describes the role of the "
    items = [shared + words(6) for _ in range(8000)]
    text = " ".join(f"{words(20)} {shared}{words(8)}" for _ in range(50))
    for i in range(0, 35, 7):
        text += f" {items[i][:30]}x{items[i][31:]} "
    raw = np.frombuffer((text + words(150_000)).encode()[:1_000_000], np.uint8)
    began = time.monotonic()
    found = decontaminate.matches(decontaminate.Block(list(range(8000)), items, 0.1), raw, np.array([0, len(raw)]))
    assert [(i, e) for _, i, e, _ in found] == [(i, 1) for i in range(0, 35, 7)]
    assert time.monotonic() - began < 20  # about 5 s on a machine with nothing else to do; 150 s were not enough pair by pair
