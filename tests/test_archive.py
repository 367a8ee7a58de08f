import pytest

from corvex.operators import archive as A

NOTE = "---\ntheme: work\n---\n# Plan\nintro\n\n## Old plan\na\n### Below\nb\n\n## Now\nc\n```\n## Code\n```\n## a [x]\nd"
ROWS = "id string, text string, theme string, path string"


def notes_of(spark, *more, text=NOTE):
    return spark.createDataFrame([("plan", text, "work", "plan.md"), ("void", None, None, None), *more], ROWS)


def pick(spark, notes, *titles, extra=()):
    keys = {(r.note, r.line.lstrip("# ")): r.key for r in A.units(notes).collect()}
    return spark.createDataFrame([("plan", keys["plan", t]) for t in titles] + list(extra), A.PICKS)


def run(spark, *titles, more=(), extra=(), text=NOTE, **options):
    notes = notes_of(spark, *more, text=text)
    return A.archive(notes, pick(spark, notes, *titles, extra=extra), "2026-10-01", **options)


def texts(plan):
    return {r.id: r.text for r in plan.files.collect()}


def test_units_are_of_the_top_level(spark):
    got = [(r.start, r.end, r.text) for r in A.units(notes_of(spark)).orderBy("start").collect()]
    assert got == [(6, 11, "## Old plan\na\n### Below\nb\n\n"), (11, 16, "## Now\nc\n```\n## Code\n```\n"), (16, 18, "## a [x]\nd")]
    body = "~~~\n## x\n```\n~~~~\n## y\r\nz\r\n"
    assert [r.text for r in A.units(notes_of(spark, text=body)).collect()] == ["## y\r\nz\r\n"]


def test_sections_move_word_for_word(spark):
    plan = run(spark, "Old plan", "a [x]")
    got = texts(plan)
    assert plan.errors.count() == 0 and set(got) == {"plan", "work-archive"}
    assert got["plan"] == "---\ntheme: work\n---\n# Plan\nintro\n\nArchived: Old plan → [[work-archive#Old plan]] (2026-10-01)\n\n## Now\nc\n```\n## Code\n```\nArchived: a [x] → [[work-archive]] (2026-10-01)"
    mark = '\n<!-- corvex:archived from="plan" date="2026-10-01" -->\n'
    assert got["work-archive"].startswith('---\ntitle: "work — archive"\ntheme: work\nsubtheme: archive\ncorvex_archive: true\n')
    assert got["work-archive"].endswith(mark + "## Old plan\na\n### Below\nb\n" + mark + "## a [x]\nd\n")
    lines = [r.line for r in plan.summary.orderBy("pos").collect()]
    assert lines == ["- 2026-10-01 · Old plan · from [[plan]] → [[work-archive#Old plan]] · ≈ 7 tokens", "- 2026-10-01 · a [x] · from [[plan]] → [[work-archive]] · ≈ 3 tokens"]
    back = A.parse_summary(plan.summary).orderBy("title").collect()
    assert [tuple(r) for r in back] == [("2026-10-01", "Old plan", "plan", "work-archive", "Old plan", 7), ("2026-10-01", "a [x]", "plan", "work-archive", "", 3)]
    assert [r.title for r in A.match(A.parse_summary(plan.summary), "an OLD plan").collect()] == ["Old plan", "a [x]"]


def test_a_second_plan_appends(spark):
    first = run(spark, "Old plan")
    got = texts(first)
    notes = spark.createDataFrame([("plan", got["plan"], "work", "plan.md"), ("work-archive", got["work-archive"], "work", "archive/work-archive.md")], ROWS)
    second = A.archive(notes, pick(spark, notes, "Now"), "2026-11-02")
    after = texts(second)
    assert after["work-archive"].startswith(got["work-archive"]) and after["work-archive"].endswith("## Now\nc\n```\n## Code\n```\n")
    assert [r.date for r in second.summary.orderBy("date").collect()] == ["2026-10-01", "2026-11-02"]
    assert second.unproved.count() == 0
    hashes = lambda n: {r.line: r.hash for r in A.units(n).collect()}
    assert hashes(notes)["## Now"] == hashes(notes_of(spark))["## Now"]  # a neighbour's link is no edit


@pytest.mark.parametrize("more,extra,said", [
    ((), [("plan", "0" * 16)], "changed since"), ((), [("none", "0" * 16)], "no such note"), ((), [("void", "0" * 16)], "no theme"),
    ([("Work-Archive", "x", "work", "work-archive.md")], (), "another note has"),
    ([("work-archive", "x", "work", "archive/work-archive.md")], (), "no archive note"),
    ([("work-archive", "---\ntheme: home\ncorvex_archive: true\n---\n", "work", "archive/work-archive.md")], (), "another theme"),
    ([("work-archive", "---\ntheme: work\ncorvex_archive: true\n---\n## old PLAN\n", "work", "archive/work-archive.md")], (), "of this title"),
    ([("archive-summary", "x", "work", "archive/archive-summary.md")], (), "summary belongs"),
    ([("gone", "## a\nb", "work", "archive/gone.md")], [("gone", "0" * 16)], "in the archive"),
])
def test_errors_change_nothing(spark, more, extra, said):
    plan = run(spark, "Old plan", more=more, extra=extra)
    assert any(said in r.error for r in plan.errors.collect()) and plan.files.count() == 0 and plan.moved.count() == 0


def test_twice_large_and_empty(spark):
    notes = notes_of(spark)
    one = pick(spark, notes, "Old plan")
    assert [r.error for r in A.archive(notes, one.union(one), "2026-10-01").errors.collect()] == ["chosen twice"]
    assert "larger" in A.archive(notes, one, "2026-10-01", most_bytes=10).errors.first().error
    none = A.archive(notes, one.limit(0), "2026-10-01")
    assert none.errors.count() == none.files.count() == none.summary.count() == 0
    assert A.units(notes.limit(0)).count() == 0


def test_equal_links_are_refused_by_the_proof(spark):
    with pytest.raises(ValueError, match="rebuilt"):
        notes = notes_of(spark, text="## a #b c\nx\n## a #b c\ny\n")
        A.archive(notes, A.units(notes).select("note", "key"), "2026-10-01")


def test_dormant_by_section_or_by_note(spark):
    from pyspark.sql import functions as F

    day = lambda s: F.expr(f"DATE '{s}'")
    old, new = 1_700_000_000_000, 1_790_000_000_000
    body = "## A\n" + "x" * 400 + "\n## B\n" + "y" * 500 + "\n## C\nz\n"
    rows = [("quiet", body, "work", "q.md", old), ("edited", body, "work", "e.md", new), ("logged", body, "work", "l.md", new), ("read", body, "work", "r.md", old), ("index", body, "index", "i.md", old), ("kept", body, "work", "archive/k.md", old), ("null", None, None, None, None)]
    notes = spark.createDataFrame(rows, ROWS + ", mtime_ms bigint")
    hashes = {r.line: r.hash for r in A.units(notes.where("id = 'logged'")).collect()}
    log = spark.createDataFrame([("logged", hashes["## A"], "2026-01-01"), ("logged", hashes["## B"], "2026-09-20")], "note string, hash string, day string").select("note", "hash", F.to_date("day").alias("first_day"))
    last = spark.createDataFrame([("read", "read", "2026-09-01"), ("quiet", "search", "2026-01-01"), ("logged", "write", "2026-09-20")], "id string, type string, day string").select("id", "type", F.to_date("day").alias("last_day"))
    got = lambda started, log_started, **kw: [(r.note, r.title, r.basis) for r in A.dormant(notes, last, log, day(started), day(log_started), day("2026-10-01"), **kw).collect()]
    assert got("2026-01-01", "2026-01-01") == [("quiet", "B", "note"), ("logged", "A", "section"), ("quiet", "A", "note")]
    assert got("2026-01-01", "2026-09-01") == [("quiet", "B", "note"), ("quiet", "A", "note")]
    assert got("2026-09-01", "2026-01-01") == [] and len(got("2026-01-01", "2026-01-01", most=1)) == 1
