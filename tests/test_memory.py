import json

from pyspark.sql import functions as F

from corvex.operators import memory as M
from corvex.sources.markdown import front_matter


def test_declared_hub(spark):
    rows = [('{"part_of": "[[Hub]]"}', ""), ('{"parent": "plain"}', ""), ("{}", "\n> Part of the big [[Plan|x]]\n"), (None, "- **Up:** no\nUp: [[Top]]"), ("{}", "one\ntwo\nthree\nfour\nfive\nUp: [[Late]]"), ("{}", "we are up to [[X]]"), ("{}", "Up: [[Alpha]]\nPart of all [[Beta]]")]
    df = spark.createDataFrame(rows, "fm string, body string")
    assert [r[0] for r in df.select(M.declared_hub(F.col("fm"), F.col("body"))).collect()] == ["Hub", "plain", "Plan", "Top", None, None, "Alpha"]


def test_pure_sibling_line(spark):
    df = spark.createDataFrame([("- [[a]], [[b]] and [[c]]",), ("See also: [[a]]",), ("[[a]] explains it",), ("no link",)], "l string")
    assert [r[0] for r in df.select(M.pure_sibling_line(F.col("l"))).collect()] == [True, True, False, False]


def test_match_hub(spark):
    hubs = spark.createDataFrame([("h1", "engine", "Spark engine plans"), ("h2", None, "Cooking book"), ("h3", None, "Cooking notes")], "id string, project string, title string")
    pick = lambda place, globs=(): [tuple(r) for r in M.match_hub(hubs, place, list(globs)).collect()]
    assert pick("/work/engine/x") == [("h1", "front matter")]
    assert pick("/work/cooking book") == [("h2", "words")] and pick("/work/cooking") == []
    assert pick("/work/x", [("/work/*", "h3")]) == [("h3", "map")]


def test_core(spark):
    e = spark.createDataFrame([(0, None, 1, "top"), (1, "G", 2, "a"), (1, "G", 3, "b")], "group_no int, group string, pos int, target string")
    hubs = spark.createDataFrame([("b",)], "id string")
    assert M.core(e, hubs, "hub text", 100).first().text == "top\nG: b\n\nhub text"
    assert M.core(e, hubs, "hub text", 1).first().text == "top"


def test_zones(spark):
    b = spark.createDataFrame([("a", "Safe"), ("b", "x"), ("c", "safe"), ("d", "x")], "id string, theme string")
    a = spark.createDataFrame([("a", "safe"), ("b", "SAFE"), ("d", "y"), ("e", "safe")], "id string, theme string")
    assert {tuple(r) for r in M.zone_violations(b, a, ["safe"]).collect()} == {("b", "moved in"), ("c", "removed"), ("e", "added")}


def test_theme_of(spark):
    df = spark.createDataFrame([("i.md", None, True), ("a/b/x.md", None, False), ("a/x.md", None, False), ("z.md", " Own ", False), ("z.md", None, False)], "rel string, d string, i boolean")
    got = [r[0] for r in df.select(M.theme_of(F.col("rel"), F.col("d"), {"a": "t1", "a/b": "t2"}, F.col("i"))).collect()]
    assert got == ["index", "t2", "t1", "own", "other"]


def test_archive_round_trip(spark):
    rows = spark.createDataFrame([("n", "Old plan — v1", 420, "arch")], "note string, title string, tokens bigint, archive string")
    back = M.parse_summary(M.summary_lines(rows, "2026-01-02"))
    r = back.first()
    assert (str(r.date), r.title, r.note, r.archive, r.tokens) == ("2026-01-02", "Old plan — v1", "n", "arch", 420)
    assert M.archive_lookup(back, ["plan", "other"]).first().score == 1


def test_small_functions(spark):
    df = spark.createDataFrame([('Sure:\n```json\n{"a": 1}\n```', "abcd", "abxy")], "t string, a string, b string")
    r = df.select(M.tolerant_json(F.col("t"), "a int").alias("j"), M.stable_share(F.col("a"), F.col("b")).alias("s")).first()
    assert r.j.a == 1 and r.s == 0.5
    d = M.line_diffs(spark.createDataFrame([(1, "a\nb", "a\nc")], "id int, before string, after string")).first().diff
    assert "-b" in d and "+c" in d
    meta = {"title": "A: b", "tags": ["x", "y"], "n": 2, "m": {"k": None}}
    assert front_matter(M.dump_front_matter(meta) + "body") == (meta, "body", None) and json.dumps(meta)


def test_old_sections_and_health(spark):
    s = spark.createDataFrame([("n", i, t, 2, 500) for i, t in enumerate(["2025-01-01", "2026-03-01", "Rules"])], "id string, pos int, title string, level int, tokens bigint")
    assert [tuple(r) for r in M.old_sections(s, F.lit("2026-01-01"), F.lit(1_790_000_000_000)).collect()] == [("n", 500)]
    notes = spark.createDataFrame([("a", 10), ("b", 6000), ("c", 1)], "id string, tokens bigint")
    r = M.health(notes, spark.createDataFrame([("a", "b")], "src string, dst string"), spark.createDataFrame([("a",)], "id string")).first()
    assert tuple(r) == (3, 6011, 1, 1, 2)
