import pytest

from corvex.operators import reshape as R

BODY = "# Hub\nintro\n\n## One\na\n### Sub\nb\n## Two\nc\n```\n## Code\n```\n- loose line  \n- loose line two\n\n## Parts\n- [[old]] — o\n\n## Last\nz\n\n"


def run(spark, *parts, body=BODY, existing=("hub", "hub-one")):
    notes = spark.createDataFrame([(i, body if i == "hub" else "x") for i in existing], "id string, body string")
    plans = spark.createDataFrame([("hub", k, *p) for k, p in enumerate(parts)], R.PLAN)
    return R.split(notes, plans)


def test_a_plan_gives_all_notes(spark):
    s = run(spark, ("One", 'says "so"', "hook", ["One"], None), ("hub-tail", "two and a line", None, ["Two"], None), ("last", "the end", " ", [], ["intro"]))
    assert s.errors.count() == 0 and s.lost.count() == 0
    got = {r.id: (r.role, r.text) for r in s.files.collect()}
    assert got["hub"] == ("hub", "# Hub\n\n## Parts\n- [[old]] — o\n- [[hub-one-2]] — hook\n- [[hub-tail]] — two and a line\n- [[hub-last]] — the end\n\n## Last\nz\n")
    assert got["hub-one-2"] == ("part", '---\ndescription: "says \\"so\\""\npart_of: hub\n---\n\n## One\na\n### Sub\nb\n')
    assert got["hub-tail"][1].endswith("---\n\n## Two\nc\n```\n## Code\n```\n- loose line  \n- loose line two\n") and got["hub-last"][1].endswith("---\n\nintro\n")


def test_lines_and_a_new_list(spark):
    s = run(spark, ("a", "lines", "h", None, ["- loose line", "z"]), body=BODY.replace("## Parts\n- [[old]] — o\n\n", ""))
    got = {r.id: r.text for r in s.files.collect()}
    assert got["hub"].endswith("## Last\n\n## Parts\n- [[hub-a]] — h\n") and got["hub-a"].endswith("---\n\n- loose line  \nz\n")


@pytest.mark.parametrize("parts,said", [
    ([("a", "d", None, ["None such"], None)], "found 0 times"),
    ([("a", "d", None, ["Code"], None)], "found 0 times"),
    ([("a", "d", None, ["One"], None), ("b", "d", None, ["Sub"], None)], "overlaps"),
    ([("a", "d", None, ["One", "One"], None)], "named twice"),
    ([("a", "d", None, None, ["b"]), ("b", "d", None, ["Sub"], None)], "found 0 times outside"),
    ([("a", "d", None, None, ["z"]), ("b", "d", None, None, ["z"])], "found 1 times outside"),
    ([("a", " ", None, ["One"], None)], "description"), ([(None, "d", None, ["One"], None)], "slug"), ([("a", "d", None, None, [])], "no sections"),
    ([("a", "d", None, None, [""])], "found"),
    ([(f"p{i}", "d", None, ["One"], None) for i in range(13)], "more than 12"),
])
def test_errors_change_nothing(spark, parts, said):
    s = run(spark, *parts)
    assert any(said in r.error for r in s.errors.collect()) and s.files.count() == 0 and s.lost.count() == 0


def test_no_note_and_no_plans(spark):
    notes = spark.createDataFrame([("n", None)], "id string, body string")
    plans = spark.createDataFrame([("other", 0, "a", "d", None, ["x"], None)], R.PLAN)
    assert {r.error for r in R.split(notes, plans).errors.collect()} >= {"no such note"}
    s = R.split(notes, plans.limit(0))
    assert s.files.count() == 0 and s.errors.count() == 0
