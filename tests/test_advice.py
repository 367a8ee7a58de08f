import os

from pyspark.sql import functions as F

from corvex.functions import text as X
from corvex.operators import advice as A
from corvex.operators import graph as G
from corvex.operators import search as S
from corvex.operators import semantic as V
from corvex.sources import markdown as M


def test_names_under_a_hub(spark):
    cases = [
        ("Jan  May!", "log-2026", "log-2026-jan-may"), ("garden-log-2026-jan", "project-garden-log-2026", "project-garden-log-2026-jan"),
        ("family-admin-photo", "family-admin-archive-map", "family-admin-archive-map-photo"), ("hub", "hub", "hub"), ("hub-x", "hub", "hub-x"), ("", "hub", "hub-part"), ("É t", "", "e-t"), ("log", "my-log", "my-log-log"),
    ]
    df = spark.createDataFrame(cases, "raw string, hub string, want string")
    assert [(r.got, r.want) for r in df.select(A.under_hub(F.col("raw"), F.col("hub")).alias("got"), "want").collect()] == [(w, w) for *_, w in cases]


def test_slugs_are_free(spark):
    wanted = spark.createDataFrame([(1, i, "a") for i in range(4)] + [(2, 0, "a"), (1, 9, "b")], "plan int, pos int, base string")
    existing = spark.createDataFrame([("A",), ("a-3",), ("c",)], "slug string")
    got = {(r.plan, r.pos): r.slug for r in A.free_slugs(wanted, existing).collect()}
    assert got == {(1, 0): "a-2", (1, 1): "a-4", (1, 2): "a-5", (1, 3): "a-6", (2, 0): "a-2", (1, 9): "b"}


def test_search_on_a_stored_index_equals_one_that_is_computed(spark, tmp_path):
    rows = [(str(i), f"Title {i}", f"note-{i}", f"dir/n{i}.md", "archive" if i == 3 else None, " ".join(f"word{(i * j) % 11} alpha" for j in range(i % 7 + 1)), i) for i in range(30)]
    notes = spark.createDataFrame(rows, "id string, title string, base string, path string, status string, body string, mtime_ms bigint")
    S.save(notes, str(tmp_path / "a"), 3)
    whole, kept = S.build(notes), S.load(spark, str(tmp_path / "a"), notes)
    for q in ("word3 alpha", "+word3 word5", "alpha -word1", '"word0 alpha"', "wor*", "word33x", '"of the"', "note-7", "title AND word2", "the"):
        a, b = ([tuple(r) for r in S.search(ix, q, page_size=20).orderBy("rank").collect()] for ix in (whole, kept))
        assert a == b, q
    assert S.search(whole, "note-7").orderBy("rank").first().id == "7"
    changed = notes.where("id = '5'").withColumn("body", F.lit("fresh zebra")).unionByName(notes.where("id = '4'").withColumn("id", F.lit("99")))
    S.update(spark, str(tmp_path / "a"), str(tmp_path / "b"), changed, notes.where("id = '6'"), 3)
    after = notes.where("id NOT IN ('5', '6')").unionByName(changed)
    new, want = S.load(spark, str(tmp_path / "b"), after), S.build(after)
    assert (new.n, round(new.mean_len, 9)) == (want.n, round(want.mean_len, 9))
    for t in ("vocabulary", "postings", "docs"):
        assert sorted(map(str, getattr(new, t).collect())) == sorted(str(r) for r in getattr(want, t).select(getattr(new, t).columns).collect())


def test_parse():
    def said(q):
        return [(c.mode, c.terms, c.prefix, bool(c.phrase), c.strict) for c in S.parse(q).clauses], S.parse(q).tags

    assert said('a1 AND b2 OR c3 NOT d4 -e5 +f6') == ([("must", ("a1",), False, False, False), ("must", ("b2",), False, False, False), ("should", ("c3",), False, False, False), ("not", ("d4",), False, False, False), ("not", ("e5",), False, False, False), ("must", ("f6",), False, False, False)], [])
    assert said('"big cat" NOT "small dog" pre* tag:x,y (z9)') == ([("must", ("big", "cat"), False, True, True), ("not", ("small", "dog"), False, True, True), ("should", ("pre",), True, False, False), ("should", ("z9",), False, False, False)], ["x", "y"])
    assert said("the")[0] == [("should", ("the",), False, False, False)] and said('un"closed quote')[0][0][1] == ("closed",)


def test_excerpts(spark):
    text = "start " + "filler words here " * 20 + "needle in the hay " + "more words after it " * 20
    r = S.excerpts(spark.createDataFrame([(text,), ("short  line",)], "line string"), ["needle"]).collect()
    assert r[1].excerpt == "short line" and "needle" in r[0].excerpt and r[0].excerpt[0] == r[0].excerpt[-1] == "…" and len(r[0].excerpt) <= 202


def test_chunks_cut_long_paragraphs(spark):
    body = "first\n\n" + "x" * 4000 + "\n\nlast"
    rows = spark.createDataFrame([("p", "T", "about", 0, "H", body), ("p", "T", None, 1, "T", "short")], "permalink string, title string, description string, pos int, heading string, text string")
    got = {r.key: (r.text, r.embed_input) for r in V.chunks_of(rows).collect()}
    assert [got[f"p#0.{i}"][0] for i in range(4)] == ["first", "x" * 1600, "x" * 1600, "x" * 800 + "\n\nlast"]
    assert got["p#1.0"][1] == "T\n\nshort" and got["p#0.0"][1] == "T\n\nabout\n\nH\n\nfirst"


def test_rescan_reads_what_changed(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"n{i}.md").write_text(f"# N{i}\nbody {i}\n")
    old = spark.createDataFrame(M.read_notes(spark, str(tmp_path)).collect(), M.NOTE)
    (tmp_path / "n1.md").write_text("# Other\n")
    os.remove(tmp_path / "n2.md")
    (tmp_path / "n9.md").write_text("new\n")
    got = {r.path: r.body for r in M.rescan(spark, str(tmp_path), old).collect()}
    assert got == {"n0.md": "# N0\nbody 0\n", "n1.md": "# Other\n", "n3.md": "# N3\nbody 3\n", "n9.md": "new\n"}
    raw = M.read_raw(spark, str(tmp_path), "n9.md").first()
    assert (raw.encoding, raw.content) == ("text", "new\n")
    assert M.synthetic_notes(spark, 40).count() == 40 and M.synthetic_notes(spark, 9).collect() == M.synthetic_notes(spark, 9).collect()
    firsts = spark.createDataFrame([("b.md", "s"), ("a.md", "s"), ("c.md", "t")], "path string, slug string")
    assert sorted(r.path for r in M.first_of_slugs(firsts).collect()) == ["a.md", "c.md"]


def test_feed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n[[B]]\n")
    q = M.feed(spark, str(tmp_path / "in")).select("path", "relations").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r.path, r.relations[0].target) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [("a.md", "B")]


def test_reading_by_identifier(spark):
    notes = spark.createDataFrame(
        [(1, "Été à Rome", "main/dir/my-note", "dir/My Note.md", "my-note"), (2, "dir/my note.md", "main/x", "x.md", "x"), (3, "Other title", "main/a/b", "A B/c.md", "c")],
        "id int, title string, permalink string, path string, slug string")
    want = {
        "dir/My Note.md": 1, "MAIN/X": 2, "My Note": 1, "my%2Dnote": 1, "memory://main/dir/my-note/": 1, "dir/my-note": 1, "ete a rome": 1, "Été à Rome": 1, "other title": 3,
        "/a/b/": 3, "a-b/c": 3, "main/a-b/c": 3, "a b/C": 3, "100%zz": None, "none": None, " ": None,
    }
    asked = spark.createDataFrame([(t,) for t in want], "target string")
    assert {r.target: r.to for r in G.read_notes(asked, notes).collect()} == want
    links = {"My Note": 1, "my note.md": 1, "OTHER TITLE": 3, "ete a Rome": 1, "x": 2, "a/b": 3, "dir/my note": 1, "memory://x": None}
    asked = spark.createDataFrame([(t,) for t in links], "target string")
    assert {r.target: r.to for r in G.resolve_links(asked, notes).collect()} == links


def test_permalinks_of_three_scripts(spark):
    want = {
        "memory/People/Jean-Éric O'Neil.md": "memory/people/jean-eric-oneil", "Заметка о Щуке.md": "zametka-o-shchuke", "Ψυχή/Θέμα.md": "psukhe/thema", "myCamelCase_note.TXT": "my-camel-case-note",
        "ő Ünnep": "o-unnep", "会议notes2024.md": "会议-notes2024", "ＡＢ会": "会", "a//b--c-/": "a//b-c/", "straße": "strasse", "v1.2 – final…": "v1.2-final...",
    }
    df = spark.createDataFrame([(k,) for k in want], "p string")
    assert {r.p: r.x for r in df.select("p", X.permalink("p").alias("x")).collect()} == want
    assert spark.range(1).select(A.kebab(F.lit(" Őszi Ｕ\u0308bung ² "))).first()[0] == "oszi-ubung-2"


def test_labels_tools_and_hints(spark):
    df = spark.createDataFrame([("note-of_x", None), ("a/b-c", "A Title"), ("x", "some-slug"), ("doc_", None), ("user_Jo-an", "user_Jo-an")], "slug string, title string")
    assert [r[0] for r in df.select(X.human_label("slug", "title")).collect()] == ["Of x", "A Title", "X", "doc_", "Jo an"]
    assert [r[0] for r in df.select(X.human_label("slug")).limit(2).collect()] == ["Of x", "A/b c"]
    tools = {"save_note": "write", "rename_file": "write", "load_note": "read", "removeNote": "write", "grep": "search", "build_context": "read", "list_directory": None, "getter": None, "get_x": "read", None: None}
    t = spark.createDataFrame([(k,) for k in tools], "t string")
    assert {r.t: r.k for r in t.select("t", X.tool_kind("t").alias("k")).collect()} == tools
    writes = spark.createDataFrame([("w", ["red", "blue", "green", "old", "new"]), ("one", ["red"])], "write string, words array<string>")
    notes = spark.createDataFrame([("a", ["red", "blue", "green"], 5), ("b", ["old", "new", "red", "x"], 9), ("c", ["red", "blue"], 99), ("d", ["blue", "green", "old", "new"], 1)], "id string, words array<string>, tokens int")
    assert [(r.write, r.id, r.shared) for r in A.duplicate_hints(writes, notes).orderBy(F.desc("shared")).collect()] == [("w", "d", 4), ("w", "b", 3)]
    w = spark.createDataFrame([(1, "Café Notes", "x"), (2, "good-slug", "./memory/"), (3, "good-slug", "deep/er"), (4, "???", "notes"), (5, " ", "")], "write int, title string, directory string")
    assert [tuple(r) for r in A.slug_hints(w, "notes").orderBy("write").collect()] == [(1, "Café Notes", "cafe-notes", False), (2, "good-slug", None, True), (4, "???", "a-kebab-slug", True)]


def test_hub_hints_meet_by_blocks(spark, monkeypatch):
    from corvex.operators import overlap as O

    monkeypatch.setattr(O, "BLOCK", 5)
    text = lambda k: " ".join(f"word{(k * j * j + j) % 13}" for j in range(k % 6))
    writes = [(w, w % 3, text(w)) for w in range(40)] + [(90, 0, None), (91, 7, "word1")]
    parts = [(p % 3, p, "" if p % 4 else text(p + 1)) for p in range(100, 137)] + [(5, 200, "")]
    label = {p: None if p % 7 == 0 else text(p) for _, p, _ in parts}
    want = {}
    for w, hub, added in writes:
        has = set((added or "").split())
        own = sorted((-len(has & set((hook or label[p] or "").split())), str(p)) for h, p, hook in parts if h == hub)
        if own:
            want[w, hub] = ([p for _, p in own[:4]], len(own) > 4)
    notes = spark.createDataFrame([(p, None, x) for p, x in label.items()], "id bigint, description string, label string")
    got = A.hub_hints(spark.createDataFrame(writes, "write bigint, hub int, added string"), spark.createDataFrame(parts, "hub int, part bigint, hook string"), notes)
    assert {(r.write, r.hub): (r.shown, r.more) for r in got.collect()} == want
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()  # no pair is a row


def test_duplicate_hints_meet_by_blocks(spark, monkeypatch):
    from corvex.operators import overlap as O

    monkeypatch.setattr(O, "BLOCK", 5)
    words = lambda k: [f"word{(k * j * j + j) % 13}" for j in range(k % 8)]
    writes = [(w, words(w)) for w in range(30)] + [(90, None), (91, ["a", "a"])]
    notes = [(n, words(n), n % 3) for n in range(100, 150)] + [(200, None, 1), (201, ["a"], 9)]
    want = set()
    for w, has in writes:
        near = [(-len(set(has or []) & set(ws or [])), -tokens, n) for n, ws, tokens in notes]
        need = max(2, -(-len(set(has or [])) * 6 // 10))
        want |= {(w, n, -s) for s, _, n in sorted(x for x in near if -x[0] >= need)[:2]}
    a = spark.createDataFrame(writes, "write bigint, words array<string>")
    got = A.duplicate_hints(a, spark.createDataFrame(notes, "id bigint, words array<string>, tokens int"))
    assert len(want) > 20 and {tuple(r) for r in got.collect()} == want
    assert "array_intersect" not in got._jdf.queryExecution().executedPlan().toString()  # no pair is a row


def test_stable_share(spark):
    rows = [("abcdef", "abcxef", 0.5), ("", "a", 0.0), ("x", "", 1.0), ("same", "same", 1.0), ("a" * 90_000 + "b", "a" * 90_000 + "c" * 10_000, 0.9)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a string, b string")
    from corvex.operators import memory

    assert [r[0] for r in df.select(memory.stable_share(F.col("a"), F.col("b"))).collect()] == [w for *_, w in rows]


def test_registered_functions(spark):
    X.register(spark)
    r = spark.sql("SELECT tok('abcde') AS a, fold_text('Été') AS b, meta_text('{\"k\": {\"x\": [1, true]}, \"title\": \"t\"}') AS c, stem_word('queries') AS d, terms('The deploying teams') AS e").first()
    assert tuple(r) == (2, "ete", "1 true", "query", ["deploy", "team"])


def test_an_index_has_a_bound_of_its_own(spark):
    notes = spark.createDataFrame([("i", "index", 2001), ("j", "index", 1900), ("k", "work", 2500), ("l", "work", 900), ("m", None, None)], "id string, theme string, tokens bigint")
    reads = spark.createDataFrame([("s", "i", 5), ("s", "i", 3), ("s", "j", 4), ("s", "k", 1), ("s", "l", 1), ("r", "i", 9), ("s", "m", 1), (None, "i", 1)], "session string, id string, t bigint")
    got = sorted(tuple(r) for r in A.index_warnings(reads, notes, 2000, 1800).collect())
    assert got == [("r", "i", 9, 2001, "index"), ("s", "i", 3, 2001, "index"), ("s", "j", 4, 1900, "size"), ("s", "k", 1, 2500, "size")]
    assert A.index_warnings(reads.limit(0), notes).count() == 0


def test_index_splits_words_once(spark):
    notes = spark.createDataFrame([(1, "a title", "body of words")], "id bigint, title string, body string")
    plan = S.postings_of(notes)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1  # nothing is computed again for the notes' lengths
    assert "struct(w, 8.0, t, true, x, coalesce" not in plan  # a word's row carries no text
    stored = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert S.index_parts(stored, least=1, size=1 << 40) == 1 and S.index_parts(stored, least=1, size=1000) > 1
    assert S.index_parts(notes) < 100  # a table without a size


def test_equal_notes_have_equal_scores_and_come_by_id(spark):
    notes = spark.range(300).select("id", F.lit("").alias("title"), F.lit("alpha beta beta gamma delta epsilon zeta " + "rest " * 7).alias("body"))
    notes = notes.unionByName(spark.createDataFrame([(1000 + i, "", "beta gamma " * (i % 3) + f"alpha word{i}") for i in range(40)], "id bigint, title string, body string"))
    got = S.search(S.build(notes.repartition(7)), "zeta alpha epsilon beta delta gamma", page_size=300).orderBy("rank").collect()
    same = [r for r in got if r.id < 300]
    assert [r.id for r in same] == list(range(300)) and len({r.score for r in same}) == 1


def test_snippets_from_the_beginning(spark):
    notes = spark.createDataFrame([(1, "filler words here " * 20 + "needle")], "id bigint, body string")
    row = lambda **k: S.snippets(notes.select("id"), notes, S.parse("needle"), **k).first().snippet
    assert row(around=False) == ("filler words here " * 20)[:199] + "…" and "needle" in row()


def test_a_slug_is_numbered_without_a_list_of_all_before_it(spark):
    wanted = spark.range(3000).select(F.lit(1).alias("plan"), F.col("id").alias("pos"), F.lit("a").alias("base"))
    existing = spark.createDataFrame([("a",), ("a-2",), ("a-7",), ("a-2999",)], "slug string")
    got = A.free_slugs(wanted, existing)
    assert "sequence(" not in got._jdf.queryExecution().optimizedPlan().toString()
    used = {1, 2, 7, 2999}
    assert [r.slug for r in got.orderBy("pos").collect()] == [f"a-{k}" for k in range(1, 3005) if k not in used]
