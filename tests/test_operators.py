import pytest
from pyspark.sql import functions as F

from corvex.operators import evaluate as B
from corvex.operators import filters as P
from corvex.operators import graph as G
from corvex.operators import lifecycle as L
from corvex.operators import search as S
from corvex.operators import usage as U


def test_parse_query():
    q = S.parse('alpha AND beta -gamma "the exact words" pre* tag:infra,ops NOT delta')
    assert [(c.mode, c.terms, c.prefix, c.strict) for c in q.clauses] == [
        ("must", ("alpha",), False, False), ("must", ("beta",), False, False), ("not", ("gamma",), False, False),
        ("must", ("exact", "word"), False, True), ("should", ("pre",), True, False), ("not", ("delta",), False, False)]
    assert q.tags == ["infra", "ops"] and q.clauses[3].phrase == " the exact words "
    assert S.parse("the").clauses[0].terms == ("the",)
    with pytest.raises(ValueError):
        S.parse("x" * 2001)


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("a", "Spark engine", "notes/a.md", ["infra"], "a spark engine runs plans", 10), ("b", "Other", "archive/b.md", ["infra"], "spark spark spark engine", 20),
        ("c", "Cooking", "c.md", ["food"], "bread and butter", 30), ("d", "Sparkling water", "d.md", ["food"], "sparkling water", 40)]
    return S.build(spark.createDataFrame(rows, "id string, title string, path string, tags array<string>, body string, mtime_ms bigint"))


def ids(df):
    return [r.id for r in df.orderBy("rank").collect()]


def test_search(index):
    assert ids(S.search(index, "spark engine"))[0] == "a"
    assert set(ids(S.search(index, "spark engine"))) == {"a", "b", "d"}
    assert set(ids(S.search(index, "+spark -runs"))) == {"b", "d"}  # d by prefix
    assert ids(S.search(index, '"bread and butter"')) == ["c"]
    assert ids(S.search(index, "breat")) == [] and ids(S.search(index, "buttex")) == ["c"]  # six letters for a typo
    assert ids(S.search(index, "spark tag:food")) == ["d"]
    assert ids(S.search(index, "tag:food")) == ["d", "c"]
    assert ids(S.search(index, "spark AND bread"))  # some of the words, where none has all
    assert ids(S.search(index, "nothing here")) == []


def test_filters(spark):
    df = spark.createDataFrame([("1", '{"n": 5, "tags": ["Été", "b"], "a": {"b": "x"}}'), ("2", '{"n": "abc"}'), ("3", None)], "id string, meta string")
    pick = lambda f: [r.id for r in df.where(f).orderBy("id").collect()]
    key = lambda k: P.path(F.col("meta"), k)
    assert pick(P.match(key("n"), {"$gte": 5})) == ["1", "2"]  # abc is compared as text
    assert pick(P.match(key("n"), {"$between": [4, 6]})) == ["1"]
    assert pick(P.match(key("tags"), {"$in": ["ete"]})) == ["1"] and pick(P.match(key("tags"), {"$nin": ["ete"]})) == ["2", "3"]
    assert pick(P.match(key("a.b"), "X")) == ["1"] and pick(P.match(key("n"), {"$exists": False})) == ["3"]
    assert pick(P.match(key("n"), {"$odd": 1})) == []


def test_components_and_bfs(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (3, 1), (7, 7)] + [(100 + i, 101 + i) for i in range(30)], "src bigint, dst bigint")
    got = {r.node: r.root for r in G.components(e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(31)}
    start = spark.createDataFrame([(100,)], "node bigint")
    assert {r.node: r.hop for r in G.neighbours(e, start, 3).collect()} == {100: 0, 101: 1, 102: 2, 103: 3}


def test_groups(spark):
    words = spark.createDataFrame([("t", i, w) for i in (1, 2, 3) for w in "abc"] + [("t", 9, "z"), ("u", 1, "a")], "theme string, id bigint, word string")
    e = spark.createDataFrame([(3, 4), (4, 3), (5, 6)], "src bigint, dst bigint")
    tied = G.ties(words, e)
    assert {tuple(r) for r in tied.collect()} == {(1, 2, 3), (1, 3, 3), (2, 3, 3)}
    notes = spark.createDataFrame([(i, "s" + str(i % 2)) for i in range(1, 10)], "id bigint, subtheme string")
    assert [tuple(r) for r in G.groups(tied, notes).select("root", "notes", "subthemes", "score").collect()] == [(1, 3, 2, 9)]


def test_ties_meet_by_blocks(spark, monkeypatch):
    from corvex.operators import overlap as O

    monkeypatch.setattr(O, "BLOCK", 7)
    has = {i: {f"w{(i * k * k + k) % 23}" for k in range(2 + i % 6)} for i in range(60)}
    words = spark.createDataFrame([("ta" if i % 5 else "u", i, w) for i, ws in has.items() for w in ws] + [(None, 77, "w1")], "theme string, id bigint, word string")
    links = [(i, (i * 7 + 3) % 50) for i in range(60)] + [(5, 5), (99, 1)]
    e = spark.createDataFrame(links, "src bigint, dst bigint")
    both = {(min(x), max(x)) for x in links if x[0] != x[1]}
    want = set()
    for a in has:
        for b in has:
            w = min(len(has[a] & has[b]), 3)
            if a < b and bool(a % 5) == bool(b % 5) and w and w + 2 * ((a, b) in both) >= 3:
                want.add((a, b, w + 2 * ((a, b) in both)))
    tied = G.ties(words, e)
    assert {tuple(r) for r in tied.collect()} == want and tied.count() == len(want) and {s for *_, s in want} >= {3, 4}
    plan = tied._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0]  # no pair is shuffled
    notes = spark.createDataFrame([(i, "s" + str(i % 2)) for i in range(60)], "id bigint, subtheme string")
    named = ("root", "notes", "subthemes", "score")
    got = {tuple(r) for r in G.tied_groups(words, e, notes).select(*named).collect()}
    assert got and got == {tuple(r) for r in G.groups(tied, notes).select(*named).collect()}


def test_hubs_claim_in_order(spark):
    pairs = [("h", "p"), ("h", "q"), ("i", "p"), ("i", "q")]
    e = spark.createDataFrame(pairs + [(b, a) for a, b in pairs[:2]], "src string, dst string")
    notes = spark.createDataFrame([(x, "f") for x in "hipq"], "id string, folder string")
    none = spark.createDataFrame([], "part string, hub string")
    assert G.hubs(e, notes, none).collect() == []  # i cites the parts from outside
    closed = e.where("src <> 'i'")
    assert {(r.part, r.hub) for r in G.hubs(closed, notes, none).collect()} == {("p", "h"), ("q", "h")}


def test_audit(spark):
    notes = spark.createDataFrame([("index", None, None), ("h", "f", "a"), ("p", "f", "a"), ("lost", "f", "zzz"), ("old", "archive/x", "a")], "id string, folder string, theme string")
    e = spark.createDataFrame([("index", "p"), ("index", "h")], "src string, dst string")
    declared = spark.createDataFrame([("p", "h")], "part string, hub string")
    listed = spark.createDataFrame([("h", "h")], "hub string, part string")
    got = {(r.rule, r.note) for r in G.audit(notes, e, declared, listed, "index", ["A"]).collect()}
    assert got == {("R1", "p"), ("R2", "p"), ("R3", "h"), ("R5", "lost"), ("R7", "lost")}


def test_sections_and_fences(spark):
    body = "intro\n## A\ntext\n```\n## not\n```\n### B\nmore\n## C"
    rows = L.section_spans(spark.createDataFrame([("n", body), ("m", "plain"), ("e", "")], "id string, body string")).orderBy("id", "pos").collect()
    assert [(r.id, r.title, r.level) for r in rows] == [("m", "", 0), ("n", "", 0), ("n", "A", 2), ("n", "B", 3), ("n", "C", 2)]
    assert rows[2].text == "## A\ntext\n```\n## not\n```"


def test_pack(spark):
    df = spark.createDataFrame([([900, 900, 900, 2500, 100],), ([],)], "t array<bigint>")
    assert [r[0] for r in df.select(L.pack(F.col("t"), 2000)).collect()] == [[1800, 900, 2500, 100], []]


def test_state_view(spark):
    rows = [("j", i, t, f"## {t}\n" + "words " * 300, 460) for i, t in enumerate(["Rules", "1 jan. 2026", "5 feb. 2026", "3 mar. 2026", "9 jan. 2026"])]
    s = spark.createDataFrame(rows, "id string, pos int, title string, text string, tokens bigint")
    r = L.state_view(s, F.lit(1_790_000_000_000)).first()
    assert r.n_dated == 4 and r.n_older == 2 and "Rules" in r.kept and "3 mar" in r.kept and "5 feb" in r.kept and "9 jan" not in r.kept


def test_budget_and_hook(spark):
    df = spark.createDataFrame([("one\ntwo\n```\ncode\n```\nend",)], "t string")
    assert df.select(L.budget(F.col("t"), 3)).first()[0] == "one\ntwo"
    hook = "a first clause that is long enough; a second clause that goes on and on and on until the line is too long"
    assert spark.createDataFrame([(hook,)], "h string").select(L.shorten_hook(F.col("h"))).first()[0] == "a first clause that is long enough"


def test_index(spark):
    body = "- [[top]] — loose\n## G\n- [[a]] — one\n- [[b]] — two\n- [[c]]\n- [[d]]\n- [[e]]\n## H\n- [[f]]"
    entries = L.index_entries(spark.createDataFrame([("i", body)], "id string, body string"))
    got = {r.group: (r.shown, r.more) for r in L.index_level(entries, spark.createDataFrame([("f",)], "id string")).collect()}
    assert got == {None: (["top"], 0), "G": (["a", "b", "c", "d"], 1), "H": (["f"], 0)}


def test_slow_alert_bounds(spark):
    now, day = 10 * 86_400_000, 86_400_000
    calls = lambda n, ms: [("search", now - 1000, float(ms))] * n + [("search", now - 2 * day, 250.0)] * 10
    slow = lambda rows: U.slow_alert(spark.createDataFrame(rows, "type string, t bigint, ms double"), now).first().slow
    assert slow(calls(10, 500)) and not slow(calls(9, 500)) and not slow(calls(10, 499))


def test_merge_counts(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3, 'c', 4) AS y")
    assert df.select(U.merge_counts(F.col("x"), F.col("y"))).first()[0] == {"a": 1, "b": 5, "c": 4}


def test_bootstrap(spark):
    runs = spark.createDataFrame([(q, v, 10.0 + q * (v == "b")) for q in range(1, 9) for v in ("a", "b")], "question bigint, variant string, value double")
    r = B.relative_difference(runs, "b", "a").first()
    assert r.n == 8 and abs(r.change - 0.45) < 1e-9 and r.low < r.change < r.high
    import numpy as np

    def step(a):  # the same in wrapping 32-bit arithmetic
        with np.errstate(over="ignore"):
            a = np.uint32(a) + np.uint32(0x6D2B79F5)
            t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
            t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
            return a, float(t ^ (t >> np.uint32(14))) / 2**32

    for seed in (0, 7, 2**32 - 1):
        a, want = seed, []
        for _ in range(5):
            a, x = step(a)
            want.append(x)
        assert B.mulberry32(seed, 5) == want
