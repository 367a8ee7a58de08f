import json
import os

import pytest

from corvex.sources import events as E
from corvex.sources import markdown as M

NOTE = b"""---
title: "D\xc3\xa9cisions: caf\xc3\xa9"
tags: [infra, "#ops"]
metadata:
  owner: ann
  levels:
    - 1
    - 2.5
summary: >
  two lines
  folded
---
# Head
- [decision] use spark #infra (2026)
- [ ] a task
- depends_on [[Other Note]] (strongly)
see [[Third|shown]] and `[[not this]]`
```
# no heading
[[no link]]
```
## Sub
text
# Next
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "a.md").write_bytes(NOTE)
    (tmp_path / "sub" / "B Note.md").write_bytes(b"\xef\xbb\xbfno front matter\r\n")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "broken.md").write_bytes(b"---\ntitle: Kept\n   x: [\nstatus: open\n---\nbody\n")
    (tmp_path / ".hidden" / "c.md").write_text("no")
    (tmp_path / "x.txt").write_text("no")
    return str(tmp_path)


def test_read_notes(spark, folder):
    notes = {r.path: r for r in M.read_notes(spark, folder).collect()}
    assert set(notes) == {"a.md", "sub/B Note.md", "broken.md"}
    a = notes["a.md"]
    assert a.title == "Décisions: café" and a.tags == ["infra", "ops"] and a.permalink == "main/a" and a.type == "note"
    assert json.loads(a.front_matter)["metadata"] == {"owner": "ann", "levels": [1, 2.5]}
    assert json.loads(a.front_matter)["summary"] == "two lines folded"
    assert [(s.heading, s.level) for s in a.sections] == [("Head", 1), ("Sub", 2), ("Next", 1)]
    assert a.sections[0].end == a.sections[2].start and a.sections[1].end == a.sections[2].start
    assert [(o.category, o.content, o.tags, o.context) for o in a.observations] == [("decision", "use spark", ["infra"], "2026")]
    assert [(r.type, r.target, r.context) for r in a.relations] == [("depends_on", "Other Note", "strongly"), ("links_to", "Third", None)]
    b = notes["sub/B Note.md"]
    assert b.title == "B Note" and b.permalink == "main/sub/b-note" and b.body == "no front matter\r\n"
    c = notes["broken.md"]
    assert c.front_matter_error and c.title == "Kept" and c.status == "open" and c.body == "body\n"


def test_note_forms():
    text = "# A closed heading ##\n#hashtag\n- is part  of [[Big|shown]] (why)\n- [x] task\n- [a](link)\n- [note] see [[One]] and [[Two#part]] #tag here\n- [[Only]]\n- **bold** [[Three]]\n[[]] [[bad]x]]"
    n = M.parse_note("dir/My Note.md", text.encode(), 5, project="work")
    assert [s["heading"] for s in n["sections"]] == ["A closed heading"] and n["permalink"] == "work/dir/my-note"
    assert [(r["type"], r["target"], r["context"]) for r in n["relations"]] == [("is_part_of", "Big", "why"), ("links_to", "One", None), ("links_to", "Two", None), ("links_to", "Only", None), ("links_to", "Three", None)]
    assert [(o["category"], o["content"], o["tags"]) for o in n["observations"]] == [("note", "see [[One]] and [[Two#part]]  here", ["tag"])]


def test_scalars():
    cases = {"": None, "~": None, "NULL": None, "True": True, "false": False, "7": 7, "-2.5": -2.5, "007": "007", "'it''s'": "it's", '"a\\n"': "a\n", "[a, 'b, c', [1]]": ["a", "b, c", [1]], "{k: v, n: 2}": {"k": "v", "n": 2}, "text # note": "text", '"bad\\q"': "bad\\q"}
    for text, want in cases.items():
        assert M.scalar(text) == want, text


def test_changed(spark, folder):
    old = M.scan(spark, folder).select("path", "mtime_ms", "size").collect()
    old = spark.createDataFrame(old)
    os.remove(f"{folder}/bad.md")
    with open(f"{folder}/new.md", "w") as f:
        f.write("x")
    with open(f"{folder}/a.md", "a") as f:
        f.write("more")
    got = {r.path: r.change for r in M.changed(old, M.scan(spark, folder, content=False)).collect()}
    assert got == {"bad.md": "removed", "new.md": "added", "a.md": "changed"}


@pytest.mark.parametrize("text,want", [("a: ~", {"a": None}), ("a: yes", {"a": "yes"}), ("a: 007", {"a": "007"}), ("a: {b: 1, c: [x, 'y, z']}", {"a": {"b": 1, "c": ["x", "y, z"]}}), ("a: |\n  x\n   y\nb: 2", {"a": "x\n y\n", "b": 2}), ("a:\n- b: 1\n  c: 2\n- d", {"a": [{"b": 1, "c": 2}, "d"]})])
def test_front_matter(text, want):
    assert M.front_matter(f"---\n{text}\n---\nbody") == (want, "body", None)


@pytest.mark.parametrize("bad", ["../x", "/x", "a/../b", ".git/x", "a//b", "C:/x"])
def test_unsafe_paths(bad):
    with pytest.raises(ValueError):
        M.safe_path(bad)


def test_edits(spark):
    body = "# A\none\n## B\ntwo\n# C\nthree\n"
    assert M.apply_edit(body, "replace_section", "new", section="B") == "# A\none\n## B\nnew\n# C\nthree\n"
    assert M.apply_edit(body, "insert_after_section", "x", section="A") == "# A\none\n## B\ntwo\nx\n# C\nthree\n"
    assert M.apply_edit("a", "append", "b") == "a\nb" and M.apply_edit("a", "prepend", "b") == "b\na"
    with pytest.raises(ValueError):
        M.apply_edit("x x", "find_replace", "y", find="x")
    df = spark.createDataFrame([("p", "x", "find_replace", "y", "x", None), ("q", "x", "find_replace", "y", "z", None)], "path string, body string, op string, text string, find string, section string")
    assert [(r.path, r.body, r.error is None) for r in M.edit_notes(df).orderBy("path").collect()] == [("p", "y", True), ("q", "x", False)]


def test_events(spark, tmp_path):
    (tmp_path / "e.jsonl").write_text('{"type":"read","ids":["a"],"source":"x","t":5}\nnot json\n{"type":"other","ids":[],"t":6}\n{"type":"search","ids":[],"t":9}\n')
    (tmp_path / "w.json").write_text('{"calls":[{"type":"write","ids":["b"],"t":3}]}')
    got = E.valid(E.read_lines(spark, str(tmp_path / "e.jsonl")))
    assert sorted((r.type, r.t) for r in got.collect()) == [("read", 5), ("search", 9)]
    assert [r.t for r in E.retain(got, 2, 10).collect()] == [9]
    assert [r.type for r in E.read_wrapped(spark, str(tmp_path / "w.json"), "calls").collect()] == ["write"]


def test_state_files_and_foreign_events(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"days": {"2024-01-02": {"notes": {"a": {"read": 2}, "b": {"search": 1, "write": 3}}}}}))
    (tmp_path / "a.json").write_text(json.dumps({"entries": [{"word": "w", "note": "a", "count": 2, "last": 5}]}))
    (tmp_path / "l.jsonl").write_text('{"t": 1, "kind": "split", "detail": "2 parts"}\nbroken\n')
    assert sorted((r.id, r.read, r.search, r.write) for r in E.read_counters(spark, str(tmp_path / "c.json")).collect()) == [("a", 2, 0, 0), ("b", 0, 1, 3)]
    assert [tuple(r) for r in E.read_aliases(spark, str(tmp_path / "a.json")).collect()] == [("w", "a", 2, 5)]
    assert [r.kind for r in E.read_log(spark, str(tmp_path / "l.jsonl")).collect()] == ["split"]
    ev = spark.createDataFrame([("read", ["a", "b"], "x", 0), ("search", [], "x", 1_800_000), ("read", ["c"], "x", 3_600_001), ("other", ["d"], "x", 9), ("read", ["a"], "y", 5)], "type string, ids array<string>, source string, t bigint")
    assert sorted((r.session, r.type, r.id or "") for r in E.calls_of(ev).collect())[:2] == [("x-1", "read", "a"), ("x-1", "read", "b")]
    assert {r.session for r in E.calls_of(ev).collect()} == {"x-1", "x-2", "y-1"}
