import re

from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import decontam as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    w, hit, ids = plain(text), set(), set()
    for item, t in items:
        b = plain(t)
        for i in range(max(1, len(b) - window + 1)) if b else ():
            g = b[i : i + window]
            for j in range(len(w) - len(g) + 1):
                if w[j : j + len(g)] == g:
                    hit |= set(range(j, j + len(g)))
                    ids.add(item)
    return hit, ids


TEXT = st.lists(st.sampled_from(["a", "B", "é", "a", "7"]), max_size=14).map(lambda x: " .".join(x))


@settings(max_examples=200, deadline=None)
@given(TEXT, st.lists(TEXT, max_size=4))
def test_scan_equals_brute_force(text, tests):
    items = [(str(i), t) for i, t in enumerate(tests)]
    ranges, ids = D.Patterns(items, 3).scan(D.words(text))
    want, want_ids = brute(text, items, 3)
    assert {k for a, b in ranges for k in range(a, b)} == want and ids == want_ids


def test_edges(spark, docs_of, odd_rows):
    tests = spark.createDataFrame([(1, odd_rows[0][1]), (2, None), (3, ""), (4, "!!"), (10, "W3 w4, w5"), (2, odd_rows[0][1]), (None, "x w1 w2")], "item_id bigint, text string")
    docs = docs_of(odd_rows)
    got = D.decontaminate(docs, tests, carry=["doc_id", "text"]).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r.text and r.text.startswith("w0"):
            assert r.item_ids == ["1", "10", "2"] and r.n_hit == 90 and r.contaminated
            assert [r.text[s.start : s.end] for s in r.spans] == [odd_rows[0][1]]
        else:
            assert r.n_hit == 0 and not r.contaminated and r.spans == []
    split = D.decontaminate(docs, tests, carry=["doc_id", "text"], shard_nodes=2000).collect()
    assert sorted(map(str, split)) == sorted(map(str, got))
    assert D.decontaminate(docs, tests.limit(0)).where("contaminated").count() == 0
    assert D.decontaminate(docs.limit(0), tests).count() == 0


def test_codes_are_unambiguous():
    for n in (1, 5, 255, 256, 16_129, 16_130, 700_000):
        width, code = D.codes(n)
        some = {code(i) for i in {0, n - 1, n // 2, n // 3}}
        assert all(len(c) == width and max(map(ord, c)) < 255 for c in some) and len(some) == len({0, n - 1, n // 2, n // 3})
        assert all(ord(c[d]) // (255 // width) == d for c in some for d in range(width))


def test_clashing_columns(spark, docs_of):
    tests = spark.createDataFrame([(1, "a b c")], "item_id bigint, text string")
    docs = docs_of([(1, "a b c"), (2, None)]).withColumnRenamed("fp", "spans").withColumnRenamed("source", "n_hit")
    got = D.decontaminate(docs, tests)
    assert got.columns.count("spans") == 1 and {(r.doc_id, r.n_hit, r.contaminated) for r in got.collect()} == {(1, 3, True), (2, 0, False)}


def test_memory_of_an_automaton_is_bounded(spark):
    """A large benchmark comes in several shards, each below the bound, and nothing of it is lost."""
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(300)]
    bench = spark.createDataFrame(rows, "item_id bigint, text string")
    found = list(D.shards(bench, "item_id", "text", 400_000))
    assert len(found) > 2 and [last for _, last in found] == [False] * (len(found) - 1) + [True]
    assert sorted(int(i) for items, _ in found for i, _ in items) == list(range(300))
    for items, _ in found:
        assert sum(len("".join([p.code[x] for x in w])) for p in [D.Patterns(items)] for _, t in items for w in D.windows(t)) <= 400_000
