import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import suffix_array as A
from corvex.llm import suffix_dedup as S


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=60), st.integers(1, 4))
def test_suffix_array_and_prefixes(b, k):
    b = bytes(x % k + 1 for x in b) + b"\0"
    s = np.frombuffer(b, np.uint8)
    sa = A.suffix_array(s)
    assert sa.tolist() == sorted(range(len(b)), key=lambda i: b[i:])
    p = A.common_prefixes(s, sa)
    for i, j in zip(sa[1:], sa):
        n = next(k for k in range(len(b)) if max(i, j) + k >= len(b) or b[i + k] != b[j + k])
        assert p[i] == n


def test_wide_alphabet_recursion():
    rng = np.random.default_rng(3)
    b = rng.integers(1, 255, 4000).astype(np.uint8)
    b = np.concatenate([b, b[:2000], [0]]).astype(np.uint8)
    raw = b.tobytes()
    assert A.suffix_array(b).tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])


def brute(rows, width=50):
    """kept bytes by row"""
    out = []
    for i, t in rows:
        b = (t or "").encode()
        seen = set()
        for j, u in rows:
            if (j if j is not None else 1 << 62) < (i if i is not None else 1 << 62):
                c = (u or "").encode()
                seen.update(c[p : p + width] for p in range(len(c) - width + 1))
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if b[p : p + width] in seen:
                gone[p : p + width] = True
        out.append((i, bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=repr)


def check(docs, rows):
    got = S.remove_repeats(docs, carry=["doc_id"]).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=repr) == brute(rows)
    for r in got:
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and r.n_bytes - r.n_removed == len(r.kept)
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_edges(spark, docs_of, odd_rows):
    check(docs_of(odd_rows), odd_rows)
    assert S.remove_repeats(docs_of(odd_rows).limit(0)).count() == 0


def test_random_passages(spark, docs_of):
    random.seed(5)
    text = lambda n: "".join(random.choice("ab cé") for _ in range(n))
    pool = [text(n) for n in (49, 50, 51, 80, 300)]
    rows = [(i, "".join(random.choice(pool) if random.random() < 0.5 else text(random.randint(0, 60)) for _ in range(random.randint(0, 6)))) for i in range(60)]
    rows += [(100 + i, "ab" * n) for i, n in enumerate((24, 25, 40, 500))] + [(200, "z" * 49), (201, "z" * 50), (202, "z" * 51)]
    check(docs_of(rows), rows)


def test_decoded_text_drops_halves(spark, docs_of):
    rows = [(1, "é" * 40), (2, "x" + "é" * 40 + "ü")]
    got = {r.doc_id: r.kept for r in S.remove_repeats(docs_of(rows), decoded=True).collect()}
    assert got == {1: "é" * 40, 2: "x"}  # the first byte of ü is that of é, and its second is nothing alone


def test_hot_anchors_and_rows_without_ids(spark, docs_of, monkeypatch):
    """One 24-byte string in very many contexts, and all rows under one id or none, stay exact and are spread."""
    random.seed(6)
    hot = "the very same twenty-four"
    letters = lambda n: "".join(random.choice("abcdef") for _ in range(n))
    rows = [(i, letters(30) + hot + letters(30)) for i in range(150)]
    rows += [(300 + i, rows[i][1]) for i in range(0, 150, 7)] + [(500, rows[3][1][10:70] + letters(20))]
    rows += [(None, x[1]) for x in rows[:5]] + [(7, x[1]) for x in rows[:40:3]]
    monkeypatch.setattr(S, "HOT_CONTEXTS", 1)
    monkeypatch.setattr(S, "HOT_CHUNKS", 2)
    check(docs_of(rows), rows)


def test_a_passage_in_all_chunks_is_not_hot():
    """One passage in the same context of a thousand chunks travels as stretches, one in many contexts string by string."""
    passage = b"A notice that stands at the end of very many texts, word for word and always the same."
    letters = np.random.default_rng(2).integers(97, 123, (5000, 60)).astype(np.uint8)
    hot = b"Z" * 8 + b"one string for them all!"
    rows = []
    for chunk in range(1000):
        texts = [passage] if chunk else [passage, *(x[:30].tobytes() + hot + x[30:].tobytes() for x in letters)]
        t = pa.table({"_cx_id": [10_000 * chunk + i for i in range(len(texts))], "_cx_text": [x.decode() for x in texts]})
        rows += S._send_anchors(1, 40)((pa.scalar(chunk),), t).to_pylist()
    told = S._match_anchors(None, pa.Table.from_pylist(rows, schema=S.ANCHORS))
    wanted, split = S._anchors_of(told)
    of = lambda x: {int(k) for *_, a in S.stretches([x]) for k in S._key(a, 40)}
    assert of(passage) <= set(wanted.tolist()) and not of(passage) & set(split.tolist()) and len(split)


def test_one_string_in_a_hundred_thousand_contexts():
    """The strings under a hot anchor go to the shards of their own hashes."""
    rng = np.random.default_rng(1)
    hot = b"Z" * 8 + b"one string for them all!"
    texts = [rng.integers(97, 123, 28).astype(np.uint8).tobytes() + hot + rng.integers(97, 123, 28).astype(np.uint8).tobytes() for _ in range(100_000)]
    anchors = np.concatenate([S._key(a, 48) for *_, a in S.stretches(texts)])
    keys, n = np.unique(anchors, return_counts=True)
    hottest = keys[n > 10_000]
    assert len(hottest)
    shards = 64
    cold = S._contents(texts, (keys, np.zeros(0, np.uint64)), 48)[1]
    spread = S._contents(texts, (keys, np.sort(hottest)), 48)[1]
    load = lambda a: np.bincount(S._shard(a, 48, shards), minlength=shards).max()
    assert load(cold) > 40_000 and load(spread) < 3 * len(spread) / shards
