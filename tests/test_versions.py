import os
import threading

import pytest

from corvex.sources import markdown as M
from corvex.sources import versions as V

SCHEMA = "path string, body string, expected bigint"


def rows(spark, *r):
    return spark.createDataFrame([(a, b, c) for a, b, c in r], SCHEMA)


def now(spark, at, version=None):
    return {r.path: (r.body, r.version) for r in V.read(spark, at, version=version).collect()}


def test_compare_and_swap(spark, tmp_path):
    at = str(tmp_path / "t")
    assert V.head(spark, at) == 0
    assert V.commit(spark, at, rows(spark, ("a", "1", None), ("b", "1", None))) == 1
    assert V.commit(spark, at, rows(spark, ("a", "2", 1), ("c", "1", None))) == 2
    for wrong in (("a", "x", 1), ("d", "x", 1), ("b", "x", None)):
        with pytest.raises(V.Conflict):
            V.commit(spark, at, rows(spark, wrong, ("e", "x", None)))
    assert now(spark, at) == {"a": ("2", 2), "b": ("1", 1), "c": ("1", 2)} and now(spark, at, 1) == {"a": ("1", 1), "b": ("1", 1)}
    assert len(os.listdir(f"{at}/data")) == 2  # what was refused is not left lying about
    assert V.commit(spark, at, rows(spark, ("a", "last", None)).drop("expected"), expected=None) == 3 and now(spark, at)["a"] == ("last", 3)


def test_trash_and_compaction(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "t")
    V.commit(spark, at, rows(spark, ("a", "1", None), ("b", "1", None), ("c", "1", None)))
    V.commit(spark, at, rows(spark, ("a", "2", 1)))
    assert V.remove(spark, at, rows(spark, ("a", None, 2), ("b", None, 1))) == 3
    assert set(now(spark, at)) == {"c"}
    assert sorted((r.path, r.body, r.removed_in) for r in V.trash(spark, at).collect()) == [("a", "2", 3), ("b", "1", 3)]
    V.commit(spark, at, rows(spark, ("b", "new", None)))  # a removed key is free again
    with pytest.raises(V.Conflict):
        V.commit(spark, at, rows(spark, ("b", "again", None)))
    V.restore(spark, at, rows(spark, ("a", None, None)))
    want = now(spark, at)
    assert want["a"][0] == "2" and want["b"][0] == "new" and V.trash(spark, at).count() == 0
    n = V.compact(spark, at)
    assert n == V.head(spark, at) and now(spark, at) == want and len(V._parts(spark, at, n)) == 1
    V.remove(spark, at, V.read(spark, at).where("path = 'c'").withColumnRenamed("version", "expected"))
    assert [r.body for r in V.trash(spark, at).collect()] == ["1"]
    monkeypatch.setattr(V, "MOST_PARTS", 2)
    for k in range(5):
        V.commit(spark, at, rows(spark, (f"k{k}", "x", None)))
    assert len(V._parts(spark, at, V.head(spark, at))) <= 3 and set(now(spark, at)) == {"a", "b", *(f"k{k}" for k in range(5))}


def test_two_writers_at_once(spark, tmp_path):
    """Of two who change one row, one wins; all who change rows of their own do, whatever numbers they wanted."""
    at = str(tmp_path / "t")
    V.commit(spark, at, rows(spark, ("shared", "0", None)))
    out, start = {}, threading.Barrier(4)

    def write(k):
        mine = rows(spark, ("shared", str(k), 1)) if k < 2 else rows(spark, (f"own{k}", "x", None))
        start.wait()
        try:
            out[k] = V.commit(spark, at, mine)
        except V.Conflict as e:
            out[k] = e

    ts = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    [t.start() for t in ts]
    [t.join(120) for t in ts]
    won = [k for k in (0, 1) if isinstance(out[k], int)]
    assert len(won) == 1 and isinstance(out[1 - won[0]], V.Conflict)
    assert isinstance(out[2], int) and isinstance(out[3], int) and len({out[won[0]], out[2], out[3]}) == 3
    got = now(spark, at)
    assert got["shared"][0] == str(won[0]) and {"own2", "own3"} <= set(got) and V.head(spark, at) == 4


def test_a_version_is_claimed_once(spark, tmp_path):
    assert V._claim(spark, str(tmp_path), 1, []) and not V._claim(spark, str(tmp_path), 1, [[1, "x", False]])
    assert V._parts(spark, str(tmp_path), 1) == [] and sorted(x for x in os.listdir(tmp_path / "versions") if not x.startswith(".")) == ["000000000001"]


def test_follow_a_folder(spark, tmp_path):
    """Added, changed and removed files arrive once each, also when it is started again."""
    src, at = tmp_path / "notes", str(tmp_path / "t")
    src.mkdir()
    for name in "abc":
        (src / f"{name}.md").write_text(f"# {name}\n")
    assert M.follow(spark, str(src), at) == 1 and M.follow(spark, str(src), at) == 1
    (src / "b.md").write_text("# other b\n")
    (src / "d.md").write_text("# d\n")
    os.remove(src / "c.md")
    assert M.follow(spark, str(src), at) == 2
    got = {r.path: (r.body, r.removed) for r in V.changes(spark, at, 1).collect()}
    assert got == {"b.md": ("# other b\n", False), "c.md": (None, True), "d.md": ("# d\n", False)}
    assert {r.path: r.body for r in V.read(spark, at).collect()} == {"a.md": "# a\n", "b.md": "# other b\n", "d.md": "# d\n"}
    assert [r.body for r in V.trash(spark, at).collect()] == ["# c\n"]
    assert M.follow(spark, str(src), at) == 2 and V.changes(spark, at, 2).count() == 0
