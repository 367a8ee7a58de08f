import pytest
from pyspark.sql import functions as F

from corvex.operators import advice as A
from corvex.operators import graph as G
from corvex.operators import lifecycle as L
from corvex.operators import semantic as V
from corvex.sources import markdown as M


def test_hooks_are_cut_only_where_the_note_keeps_the_detail(spark):
    long = "Choosing a database for the ledger; notes on replication, vacuum settings, timeouts and the failover drill of March"
    bullets = spark.createDataFrame([(1, "kept", long), (2, "lost", long), (3, "short", "a short hook"), (4, "none", long), (5, "null", None), (6, "kept", "[[other]] " + long)], "pos int, id string, hook string")
    body = "About replication with vacuum settings. Timeouts were checked, and the failover drill took place in March; see the notes."
    notes = spark.createDataFrame([("kept", body), ("lost", "nothing of that"), ("short", ""), ("null", "x")], "id string, body string")
    got = L.index_trim(bullets, notes).collect()
    assert [(r.pos, r.id, r.short) for r in got] == [(1, "kept", "Choosing a database for the ledger; notes on replication, vacuum settings")]  # the last clause end that fits


@pytest.mark.parametrize("hook,short", [
    ("x" * 40, "x" * 40),
    ("one two three four five six seven — eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen", "one two three four five six seven"),
    ("z" * 90 + " — more", "z" * 90), ("z" * 91 + " — more", "z" * 90), ("The settings of every machine: what runs. More " + "word " * 20, "The settings of every machine"), ("ab (cd) " + "word " * 30, None), ("y" * 120, "y" * 90),
])
def test_hooks_end_at_a_clause_or_a_word(spark, hook, short):
    got = spark.createDataFrame([(hook,)], "h string").select(L.shorten_hook(F.col("h"))).first()[0]
    assert got == short if short else (len(got) <= 90 and hook.startswith(got) and hook[len(got)] == " ")


def test_detail_is_kept_where_nothing_significant_goes(spark):
    rows = spark.createDataFrame([("of the a", None), ("alpha beta gamma delta omega", "alpha beta gamma delta"), ("alpha beta", "alpha"), (None, "x")], "d string, e string")
    assert [r[0] for r in rows.select(L.detail_kept(F.col("d"), F.col("e"))).collect()] == [True, True, False, True]


def test_vectors_are_stored_with_what_made_them(spark, tmp_path):
    rows = [("a#0.0", "a", "h1", [1.0, 0.0]), ("b#0.0", "b", "h2", [0.0, 1.0, 0.0]), ("c#0.0", "c", "h3", None)]
    chunks = spark.createDataFrame(rows, "key string, permalink string, hash string, vector array<float>")
    path = str(tmp_path / "vectors")
    V.store(chunks, path, "local", "m", 2)
    got = V.load(spark, path, "local", "m", 2)
    assert got.columns == ["key", "permalink", "hash", "vector"] and [r.key for r in got.collect()] == ["a#0.0"]  # others have another length
    assert V.load(spark, path, "local", "n", 2).count() == V.load(spark, path, "other", "m", 2).count() == V.load(spark, path, "local", "m", 3).count() == 0
    wanted = spark.createDataFrame([("a#0.0", "h1"), ("b#0.0", "new")], "key string, hash string")
    assert [r.key for r in V.prune(chunks, wanted).collect()] == ["a#0.0"] and [r.key for r in V.missing(wanted, chunks).collect()] == ["b#0.0"]


def test_families_orphans_and_fingerprints(spark):
    pairs = spark.createDataFrame([("a", "a-b"), ("a-b", "a"), ("a", "ab"), ("a", "a"), ("a-b", "a-c")], "a string, b string")
    assert [r[0] for r in pairs.select(G.same_family(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "id string")
    assert [r.id for r in A.orphan_hints(ids("a", "b", "c"), ids("a"), ids("c", "c")).collect()] == ["b"]
    texts = spark.createDataFrame([("a  b\n",), ("a b ",), ("a c",), (None,)], "t string")
    one, two, three, none = (r[0] for r in texts.select(M.body_fingerprint(F.col("t"))).collect())
    assert one == two != three and none is None


def test_a_folder_lists_sizes_and_a_snapshot_replaces(spark, tmp_path):
    folder, table = tmp_path / "notes", str(tmp_path / "table")
    (folder / "sub").mkdir(parents=True)
    (folder / "a.md").write_text("abc")
    (folder / "sub" / "b.md").write_text("é")
    assert sorted((r.path, r.size) for r in M.sizes(spark, str(folder)).collect()) == [("a.md", 3), ("sub/b.md", 2)]
    for rows in ([("a", 1), ("b", 2)], [("c", 3)]):
        M.write_snapshot(spark.createDataFrame(rows, "id string, n int"), table)
    assert [tuple(r) for r in spark.read.parquet(table).collect()] == [("c", 3)]
