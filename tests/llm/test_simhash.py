import random

import numpy as np
import xxhash

from corvex.llm import simhash as H


def brute_print(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(prints):
    """smallest id by row, of (id, print)"""
    label = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j][1]).count("1") <= 3:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
    low = {}
    for (d, _), v in zip(prints, label):
        if d is not None:
            low[v] = min(low.get(v, d), d)
    return [low.get(v) for v in label]


def test_edges(spark, docs_of, odd_rows):
    got = H.near_duplicates(docs_of(odd_rows)).collect()
    prints = [(i, brute_print(t)) for i, t in odd_rows]
    want = sorted((str(i), p, str(c)) for (i, p), c in zip(prints, brute_components(prints)))
    assert sorted((str(r.doc_id), r.fp & (1 << 64) - 1, str(r.component_id)) for r in got) == want
    kept = sorted(str(r.doc_id) for r in H.keep_one(docs_of(odd_rows)).collect())
    assert kept == sorted({str(c) for c in brute_components(prints) if c is not None} | {"None"})
    assert H.near_duplicates(docs_of(odd_rows).limit(0)).count() == 0


def test_links_lose_nothing_when_buckets_overflow(spark, monkeypatch):
    random.seed(2)
    monkeypatch.setattr(H, "BUCKET", 8)
    centre = random.getrandbits(64)
    fps = {centre ^ sum(1 << random.randrange(64) for _ in range(random.randint(0, 5))) & (1 << 64) - 1 for _ in range(150)} | {random.getrandbits(64) for _ in range(150)}
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = H.components(H.links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))).collect()
    root = {r.node: r.root for r in found}
    label = [root.get(f, f) for f in signed]
    want = brute_components(list(enumerate(fps)))
    for i in range(len(fps)):
        for j in range(i):
            assert (label[i] == label[j]) == (want[i] == want[j])


def test_masks_guarantee():
    for blocks in H.FAMILIES:
        ms = [m & (1 << 64) - 1 for m in H.masks(blocks)]
        assert all(bin(m).count("1") >= 12 for m in ms)
        for _ in range(200):
            d = sum(1 << b for b in random.sample(range(64), 3))
            assert any(not d & m for m in ms)
    assert max(64 - bin(m & (1 << 64) - 1).count("1") for m in H.masks(16)) == 12


def test_forest_spans():
    fps = np.array([0, 1, 3, 15, 31, 7 << 40 | 7, 255 << 20], np.int64)
    assert sorted(H.forest(fps)) == [(1, 0), (3, 0), (15, 0), (31, 0)]


def test_rows_of_one_id_in_different_groups(spark, docs_of):
    a, b, c = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    rows = [(1, a), (2, b), (2, a), (3, c), (3, b), (5, "own " + c[::-1]), (5, b[::-1]), (5, b[::-1]), (6, a)]
    got = sorted((r.doc_id, r.text) for r in H.keep_one(docs_of(rows)).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (5, "own " + c[::-1]), (5, b[::-1])])
