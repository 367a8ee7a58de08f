import hashlib
import random
import re
import zlib

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import periodic_runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=R.LEAST):
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= least:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(w, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def judged(texts, least=R.LEAST):
    n, runs, kept = R._judge(pa.array(texts, pa.string()), least)
    return [(a, [tuple(r.values()) for r in b], c) for a, b, c in zip(n.to_pylist(), runs.to_pylist(), kept.to_pylist())]


def check(texts, least=R.LEAST):
    for t, (n, runs, kept) in zip(texts, judged(texts, least)):
        w = WORD.findall(t or "")
        want = brute(w, least)
        assert (n, runs, kept) == (len(w), want, collapsed(w, want)), t


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 4), st.integers(1, 30), st.integers(0, 10**6)), max_size=6), st.sampled_from([2, 4, 12]))
def test_equals_brute_force_side_by_side(shapes, least):
    texts = []
    for n, kinds, period, seed in shapes:
        r = random.Random(seed)
        w = [r.choice("abcd"[:kinds]) for _ in range(period if seed % 2 else n)]
        texts.append(" ".join(w[i % len(w)] for i in range(n)) if w else "")
    check(texts, least)


def test_known_shapes(monkeypatch):
    monkeypatch.setattr(R, "NEAR", 3)
    fib = ["a", "a b"]
    while len(fib) < 12:
        fib.append(fib[-1] + " " + fib[-2])
    block = " ".join(f"x{i}" for i in range(40))
    texts = [
        None, "", " \t\n", "a " * 11, "a " * 12, "a b " * 6, "a b a b a b a b a b a", fib[-1], f"{block} {block}", f"{block} y {block}",
        "a b c " * 4 + "z " + "a b c " * 4, "  " * 12, "\x1c \x1c " * 6, f"s {'a b ' * 8}{'b c ' * 8}", " ".join(["q"] * 500),
    ]
    check(texts)
    assert judged(["a " * 12])[0] == (12, [(0, 12, 1)], "a")


def test_operator(spark, docs_of, odd_rows):
    out = R.find_runs(docs_of(odd_rows)).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        w = WORD.findall(r.text or "")
        assert [tuple(x) for x in r.runs] == brute(w) and r.collapsed == collapsed(w, brute(w)) and r.n_words == len(w)
    assert R.find_runs(docs_of(odd_rows).limit(0)).count() == 0
    clash = spark.createDataFrame([(1, "a " * 14, "mine", 5)], "doc_id bigint, text string, runs string, collapsed int")
    assert R.find_runs(clash).first().asDict()["collapsed"] == "a" and len(R.find_runs(clash).columns) == 5


def test_long_and_wide(spark):
    """Periods to half of a long text, more texts than a part holds, and one text larger than a part."""
    period = [f"w{i}" for i in range(997)]
    texts = [" ".join(period[i % 997] for i in range(4000)), "u v w x y z " * 3000] + [f"t{i} a b c" for i in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    out = {r.doc_id: r for r in R.find_runs(docs).collect()}
    assert [tuple(x) for x in out[0].runs] == [(0, 4000, 997)] and [tuple(x) for x in out[1].runs] == [(0, 18000, 6)]
    assert not any(out[i].runs for i in range(2, 502))


def test_query_with_planted_runs(spark, tmp_path):
    from corvex.llm.queries import op13_periodic_runs

    rng = random.Random(5)
    rows = [(i, None if i % 19 == 0 else " ".join(rng.choice("abcdefgh") for _ in range(i % 90))) for i in range(160)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    planted = 0
    got = {r.doc_id: r for r in op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in rows:
        w = WORD.findall(text or "")
        h = zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
            planted += 1
        runs = brute(w)
        best = min(((-n, a, q) for a, n, q in runs), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == ((best[1], -best[0], best[2]) if best else (None, None, None))
        assert r.exponent_milli == (1000 * -best[0] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert planted > 5


def test_work_stays_linear_in_a_log(monkeypatch):
    """Smaller halves: positions looked at as splitters, over all lengths, stay under n log n."""
    seen = []
    refine = R.Partition.refine
    monkeypatch.setattr(R.Partition, "refine", lambda self: (seen.append(len(self.split)), refine(self))[1])
    fib = ["a", "a b"]
    while len(fib) < 17:
        fib.append(fib[-1] + " " + fib[-2])
    n = judged([fib[-1]])[0][0]
    assert n > 2500 and sum(seen) < 2 * n * n.bit_length()
