import random

import pytest
from pyspark.sql import functions as F

from corvex.operators import evaluate as B
from corvex.operators import graph as G
from corvex.operators import scan
from corvex.operators import usage as U


def calls(spark, n, seed, sessions=2, span=400):
    r = random.Random(seed)
    rows = [(i, r.choice(["search", "search", "search", "read"]), r.randrange(sessions), r.randrange(span)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "call_id int, type string, session int, t bigint")


@pytest.mark.parametrize("seed,parts,sessions", [(1, 1, 2), (2, 7, 1), (3, 40, 2), (4, 300, 1)])
def test_bursts_over_all_calls(spark, seed, parts, sessions):
    """Against one pass over all calls in order, with stretches down to a call each."""
    rows, df = calls(spark, 300, seed, sessions)
    want, run = [], []

    def close():
        want.extend((run[k][2], run[k][0], len(run[k : k + 4]), run[k][3]) for k in range(0, len(run), 4) if len(run[k : k + 4]) > 1)
        run.clear()

    for c in sorted(rows, key=lambda x: (x[3], x[0])):
        if run and (c[1] != "search" or c[2] != run[-1][2] or c[3] - run[-1][3] > 3):
            close()
        if c[1] == "search":
            run.append(c)
    close()
    assert sorted(tuple(r) for r in U.bursts_in_order(df, 3, parts=parts).collect()) == sorted(want)


def test_numbers_over_all_rows(spark):
    rows, df = calls(spark, 500, 5, span=60)
    got = {r.call_id: r.pos for r in scan.numbered(df, "t", ["call_id"], parts=9).collect()}
    assert got == {c[0]: k for k, c in enumerate(sorted(rows, key=lambda x: (x[3], x[0])))}
    assert scan.numbered(df.limit(0), "t", ["call_id"]).count() == 0 and U.bursts_in_order(df.limit(0)).count() == 0


def test_no_window_over_all_rows(spark, capsys):
    _, df = calls(spark, 50, 6)
    U.bursts_in_order(df, parts=4).explain("formatted")
    assert "SinglePartition" not in capsys.readouterr().out


def test_draws_need_none_before_them(spark):
    for seed in (0, 7, 2**32 - 1):
        got = [r[0] for r in spark.range(300).orderBy("id").select(B.draw(F.col("id"), seed)).collect()]
        assert got == B.mulberry32(seed, 300)
    runs = spark.createDataFrame([(q, v, 10.0 + q * (v == "b") * (q % 3)) for q in range(30) for v in ("a", "b")], "question bigint, variant string, value double")
    u = B.mulberry32(B.SEED, B.RESAMPLES * 30)
    boots = sorted(sum(10.0 + q * (q % 3) for q in qs) / 300 - 1 for qs in ([int(x * 30) for x in u[k : k + 30]] for k in range(0, len(u), 30)))
    r = B.relative_difference(runs, "b", "a").first()
    assert r.n == 30 and abs(r.low - boots[B.LOW]) < 1e-12 and abs(r.high - boots[B.HIGH]) < 1e-12
    assert B.relative_difference(runs.where("variant = 'a'"), "b", "a").count() == 0


def walk(edges, folder, declared, index):
    """Hubs in the order of their ids, one after the other."""
    out, inc = {}, {}
    for a, b in edges:
        if a != b:
            out.setdefault(a, set()).add(b)
            inc.setdefault(b, set()).add(a)
    claimed = dict(declared)
    for h in sorted(set(folder) - {index}):
        group = {b for b in out.get(h, ()) if b != index and b in inc.get(h, ()) and folder[b] == folder[h] and claimed.get(b, h) == h}
        while True:
            kept = {b for b in group if inc[b] - {index} <= group | {h}}
            if kept == group:
                break
            group = kept
        if len(group) >= 2:
            for b in group:
                claimed.setdefault(b, h)
    return claimed


@pytest.mark.parametrize("seed", range(6))
def test_hubs_claim_as_if_one_after_the_other(spark, seed):
    r = random.Random(seed)
    names = [f"n{i:02d}" for i in range(26)]
    edges, folder = set(), {n: r.choice(["f", "f", "g"]) for n in names}
    for _ in range(9):  # groups that overlap, some closed, some linked from outside
        hub, parts = r.choice(names), r.sample(names, r.randint(2, 4))
        edges |= {(hub, p) for p in parts} | {(p, hub) for p in parts}
        if r.random() < 0.5:
            edges |= {(a, b) for a in parts for b in parts if a != b}
        if r.random() < 0.2:
            edges.add((r.choice(names), r.choice(parts)))
    for n in r.sample(names, 8):
        edges.add(("n00", n))
    declared = {names[5]: names[9], names[6]: names[1]} if seed % 2 else {}
    e = spark.createDataFrame(sorted(edges), "src string, dst string")
    n = spark.createDataFrame([(k, None if v == "g" else v) for k, v in folder.items()], "id string, folder string")
    d = spark.createDataFrame(list(declared.items()), "part string, hub string")
    got = {x.part: x.hub for x in G.hubs(e, n, d, "n00").collect()}
    assert got == walk(edges, folder, declared, "n00")
