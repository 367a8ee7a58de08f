import random

import pytest

from corvex.operators import context as C

NOTES = "id string, permalink string, path string, title string, mtime_ms bigint"
EDGES = "src string, type string, target string, dst string, pos int"


def tables(spark, n, edges, rng=None):
    rows = [(f"n{i}", f"main/f{i % 3}/n{i}", f"f{i % 3}/n{i}.md", f"Note {i}", (i * 37) % 10) for i in range(n)]
    return spark.createDataFrame(rows, NOTES), spark.createDataFrame(edges, EDGES)


def walk(notes, edges, page, start, depth, most, since):
    """The surroundings of one note, one edge after the other."""
    times = {r.id: r.mtime_ms for r in notes}
    out, into, used = {}, {}, set()
    for e in sorted(edges, key=lambda e: (e[0], e[4])):
        if (e[0], e[1], e[2].lower()) not in used:
            used.add((e[0], e[1], e[2].lower()))
            out.setdefault(e[0], []).append(e)
            if e[3]:
                into.setdefault(e[3], []).append(e)
    got, seen, rels, front = [], {start}, set(), [start]
    for _ in range(depth):
        nxt = []
        for cur in front:
            for e in out.get(cur, []) + into.get(cur, []):
                if len(got) >= most:
                    return got
                r = (e[0], e[1], e[2].lower())
                if r not in rels:
                    rels.add(r)
                    got.append(("relation", None, e[0], e[1], e[2], e[3]))
                other = e[3] if e[0] == cur else e[0]
                if not other or other in seen or other in page:
                    continue
                seen.add(other)
                if times[other] < since or len(got) >= most:
                    continue
                got.append(("entity", other, None, None, None, None))
                nxt.append(other)
        front = nxt
    return got


@pytest.mark.parametrize("seed,depth,most", [(1, 1, 10), (2, 2, 7), (3, 3, 30), (4, 2, 1)])
def test_against_a_walk(spark, seed, depth, most):
    rng = random.Random(seed)
    edges = []
    for i in range(30):
        for pos in range(rng.randrange(4)):
            k = rng.choice([0, rng.randrange(34)])
            edges.append((f"n{i}", rng.choice("ab"), rng.choice(["n", "N"]) + str(k), f"n{k}" if k < 30 else None, pos))
    notes, e = tables(spark, 30, edges)
    asked = spark.createDataFrame([("memory://f1/*",), ("n0",), ("f2",), ("none",), (None,)], "url string")
    got = C.context(asked, notes, e, 3, depth=depth, most=most, size=4)
    rows = notes.collect()
    pages, related = {}, {}
    for r in got.primaries.collect():
        pages.setdefault(r.url, {})[r.rank] = r.id
    for r in got.related.orderBy("pos").collect():
        related.setdefault((r.url, r.id), []).append((r.kind, r.node, r.src, r.type, r.target, r.dst))
    assert set(pages) == {"memory://f1/*", "n0", "f2"} and pages["n0"] == {1: "n0"}
    time = {r.id: (-r.mtime_ms, r.permalink) for r in rows}
    assert [pages["f2"][k] for k in (1, 2, 3, 4)] == sorted((f"n{i}" for i in range(2, 30, 3)), key=time.get)[:4]
    for url, page in pages.items():
        for p in page.values():
            assert related.get((url, p), []) == walk(rows, edges, set(page.values()), p, depth, most, 3), (url, p)
    counts = {r.url: r for r in got.counts.collect()}
    assert counts["f2"].total_primaries == 10 and counts["f2"].primary_count == 4 and counts["none"].total_results == 0
    assert counts["f2"].related_count == sum(len(v) for (u, _), v in related.items() if u == "f2")


def test_names_and_folders(spark):
    notes, e = tables(spark, 6, [("n0", "a", "n1", "n1", 0)])
    asked = spark.createDataFrame([(u,) for u in ("memory://main/f1", "F1/n*", "*n5", "f1/N1.md", "/f1/n4/", "f1/n", "\\E*", "*")], "url string")
    got = {}
    for r in C.designated(asked, notes).collect():
        got.setdefault(r.url, set()).add(r.id)
    assert got == {"memory://main/f1": {"n1", "n4"}, "F1/n*": {"n1", "n4"}, "*n5": {"n5"}, "f1/N1.md": {"n1"}, "/f1/n4/": {"n4"}, "*": {f"n{i}" for i in range(6)}}


def test_none_and_bounds(spark):
    notes, e = tables(spark, 3, [("n0", "a", "n1", "n1", 0)])
    asked = spark.createDataFrame([("n0",)], "url string")
    seen = spark.createDataFrame([("n0",), ("n0",), ("n1",)], "id string")
    alone = C.context(asked, notes, e, 0, depth=0, observations=seen)
    assert alone.related.count() == 0 and alone.counts.first().total_observations == 2
    assert C.context(asked.limit(0), notes, e, 0).counts.count() == 0
    assert C.context(asked, notes.limit(0), e.limit(0), 0).counts.first().total_results == 0
    with pytest.raises(ValueError):
        C.context(asked, notes, e, 0, depth=11)
