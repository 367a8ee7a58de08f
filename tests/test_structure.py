"""The audit and its fixes on a small knowledge base, rule by rule."""

import pytest
from pyspark.sql import functions as F

from corvex.operators import structure as S

FM = "---\ntheme: {}\n{}---\n"


def note(i, body, theme="work", more="", folder="work"):
    return (i, FM.format(theme, more) + body, folder, i.title(), None)


NOTES = [
    ("index", "# Index\n\n## work\n### a\n- [[hub]] — h\n### b\n- [[late]]\n- [[other]]\n- [[gone]]\n\n## Archive (old)\n- [[live]]\n- [[dead]]\n", "", "Index", None),
    note("hub", "\n# Hub\n[[p1]] and [[p2]]\n\n## Parts\n- [[p1]] — one\n- [[loose]]\n\n## After\ntext\n"),
    note("p1", "\n# P1\nUp: [[hub]]\n", more="part_of: hub\n"),
    note("p2", "\n\n# P2\nnothing\n", more="part_of: '[[HUB]]'\n"),
    note("p3", "\nUp: [[hub]]\n- [[p1]], [[p2]]\nas [[p1]] and [[p2]] say\n`[[p1]] [[p2]]`\n```\n[[p1]] [[p2]]\n```\n", more="part_of: hub\n"),
    note("late", "# Late\n[[hub]]\n", more="part_of: hub\nsous_theme: x\n"),
    note("other", "text\n", more="sous_theme: x\n"),
    note("gone", "old\n", more="status: 'archived'\n"),
    note("live", "new\n", more="sous_theme: x\n"),
    note("dead", "dead\n", folder="x/Archive"),
    note("loose", "no hub yet\n"),
    note("odd", "alone\n", theme="nonsense", more="subtheme: work\n"),
    ("bare", "no front matter, named twice\n", "work", "Bare", "a hook"),
    note("h2", "# H2\n## Parts\n- [[bare]]\n"), note("h3", "## Parts\n- [[bare]]\n"),
    note("archive/z", "z\n", folder="archive"),
    ("empty", None, None, None, None),
]
SCHEMA = "id string, text string, folder string, label string, description string"


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame(NOTES, SCHEMA)


@pytest.fixture(scope="module")
def structure(base):
    return S.Structure(base, "index", themes=("work",))


@pytest.fixture(scope="module")
def issues(structure):
    return S.G.cut(S.audit(structure))


def test_all_rules(issues):
    got = {(r.rule, r.note, r.part, r.hub, r.section, r["sub"], r.fix) for r in issues.collect()}
    want = {
        ("R1", "index", "late", "hub", None, None, None),
        ("R2", "p2", None, "hub", None, None, "add-up-line"),
        ("R3", "hub", "p3", "hub", None, None, "append-hub-parts-line"), ("R3", "hub", "late", "hub", None, None, "append-hub-parts-line"),
        ("R3", "loose", None, "hub", None, None, "add-part-of"), ("R3", "bare", None, None, None, None, None),
        ("R4", "p3", "p1,p2", "hub", None, None, None),
        ("R5", "odd", None, None, None, None, None), ("R5", "h2", None, None, None, None, None), ("R5", "h3", None, None, None, None, None), ("R5", "empty", None, None, None, None, None),
        ("R6", "index", "live", None, "work", "b", "move-index-line"), ("R6", "index", "gone", None, "Archive (old)", None, "move-index-line"),
        ("R7", "odd", None, None, "work", None, None),
    }
    assert got == want
    r4 = sorted((r.line, r.detail) for r in issues.where("rule = 'R4'").collect())
    assert [d for _, d in r4] == ["sibling links alone", "links in prose"] and r4[1][0] == r4[0][0] + 1


def test_fixes_write_the_lines(structure, issues):
    got = {r.id: r.after for r in S.fix(structure, issues).collect()}
    assert got["p2"] == FM.format("work", "part_of: '[[HUB]]'\n") + "\nUp: [[hub]] — part of hub.\n\n# P2\nnothing\n"
    assert got["hub"] == FM.format("work", "") + "\n# Hub\n[[p1]] and [[p2]]\n\n## Parts\n- [[p1]] — one\n- [[loose]]\n- [[late]] — Late\n- [[p3]] — P3\n\n## After\ntext\n"
    assert got["loose"] == FM.format("work", "part_of: hub\n") + "no hub yet\n"
    assert got["index"] == "# Index\n\n## work\n### a\n- [[hub]] — h\n### b\n- [[late]]\n- [[other]]\n- [[live]]\n\n## Archive (old)\n- [[dead]]\n- [[gone]]\n"
    assert set(got) == {"p2", "hub", "loose", "index"}


def test_repair_ends_without_fixes_and_loses_nothing(spark, base):
    fixed, rounds = S.repair(base, "index", themes=("work",))
    assert rounds == 2
    s = S.Structure(fixed, "index", themes=("work",))
    assert S.audit(s).where("fix IS NOT NULL").count() == 0
    both = base.select("id", F.coalesce("text", F.lit("")).alias("before")).join(fixed.select("id", F.col("text").alias("after")), "id")
    assert S.lost_lines(both).count() == 0


def test_fixes_asked_for_by_hand(spark, structure):
    rows = [
        ("attach", "odd", None, "hub", None, None, None, None), ("attach", "bare", None, "h2", None, None, None, None), ("append-index-section-line", "index", "odd", None, None, "b", None, "hook"),
        ("append-index-section-line", "index", "hub", None, None, "b", None, "twice"), ("remove-line", "p3", None, None, 6, None, None, None), ("remove-line", "p3", None, None, 99, None, None, None),
        ("replace-index-line", "index", "late", "p1", 6, None, None, None), ("append-hub-parts-line", "hub", "p1", "hub", None, None, None, None), ("append-hub-parts-line", "other", "bare", "other", None, None, None, None),
        ("move-index-line", "index", "dead", None, None, "no such section", None, None),
    ]
    fixes = spark.createDataFrame([(*r, None) for r in rows], "fix string, note string, part string, hub string, line int, section string, sub string, hook string, detail string")
    got = {r.id: r.after for r in S.apply_edits(structure, S.schedule(S.edits(fixes, structure))).collect()}
    assert got["odd"] == FM.format("nonsense", "subtheme: work\npart_of: hub\n") + "\nUp: [[hub]] — part of hub.\n\nalone\n"
    assert "bare" not in got  # no front matter to put a key into
    assert got["index"].split("\n")[2:10] == ["## work", "### a", "- [[hub]] — h", "### b", "- [[p1]]", "- [[other]]", "- [[gone]]", "- [[odd]] — hook"]
    assert "- [[p1]], [[p2]]" not in got["p3"] and "as [[p1]] and [[p2]] say" in got["p3"]
    assert got["other"].endswith("text\n\n## Parts\n- [[bare]] — a hook\n") and "hub" not in got


def test_edits_that_touch_wait(spark, structure):
    rows = [("index", 3, 2, ["x"], "3"), ("index", 4, 1, [], "3"), ("index", 5, 0, ["y"], "6"), ("hub", 4, 0, ["z"], "6")]
    e = S.schedule(spark.createDataFrame(rows, S.EDIT))
    assert sorted((r.id, r.at, r.now) for r in e.collect()) == [("hub", 4, True), ("index", 3, True), ("index", 4, False), ("index", 5, True)]


def test_duplicates_are_reported(structure, spark):
    w = [f"w{i}" for i in range(8)]
    words = spark.createDataFrame([("p1", "work", None, 10, w, w[:3]), ("p2", "work", None, 9, w[:7], w[:3]), ("archive/z", "work", None, 9, w, w)], "id string, theme string, subtheme string, tokens int, words array<string>, title_words array<string>")
    assert [(r.rule, r.note, r.part) for r in S.possible_duplicates(structure, words).collect()] == [("D1", "p1", "p2")]


def test_no_notes(spark, base):
    s = S.Structure(base.limit(0), "index")
    assert S.audit(s).count() == 0 and S.fix(s, S.audit(s)).count() == 0
