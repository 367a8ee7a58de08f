from pyspark.sql import functions as F

from corvex.llm import licenses as C

TEMPLATES = {"short": "Released under Mit terms here.", "long": " ".join(f"term{i}" for i in range(60))}


def brute(rows, span):
    out = set()
    for i, t in rows:
        w = C._words_of(t or "")
        places = [(k, " ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))] if w else []
        for name, tpl in TEMPLATES.items():
            want = set(C._shingles_of(tpl))
            best = max((len({s for k, s in places if k // span in (n, n + 1)} & want) for n in range(-1, len(w) // span + 1)), default=0)
            if best >= C.CONTAINED * len(want):
                out.add((i, name, best, len(want)))
    return out


def test_containment(spark, docs_of):
    fill = " ".join(f"x{i}" for i in range(50))
    long = TEMPLATES["long"].split()
    rows = [
        (1, f"{fill} released UNDER mit, terms here {fill}"), (2, "released under mit terms"), (3, fill + " " + TEMPLATES["long"] + " " + fill),
        (4, " ".join(long[:47])), (5, " ".join(long[:52])), (6, " ".join(long[:30]) + " gap " + " ".join(long[30:])), (7, None), (8, ""), (9, "term1 " * 100),
        (10, TEMPLATES["long"] + " " + TEMPLATES["short"]), (11, f"{fill} {fill} {TEMPLATES['long']} tail"),
    ]
    got = {(r.doc_id, r.license_id, r.n_matched, r.n_shingles) for r in C.scan(docs_of(rows), TEMPLATES).collect()}
    assert got == brute(rows, 56) and {x[:2] for x in got} >= {(1, "short"), (3, "long"), (5, "long"), (6, "long"), (10, "short")}


def test_edges(spark, docs_of, odd_rows):
    docs = docs_of([*odd_rows, (None, TEMPLATES["short"]), (20, TEMPLATES["short"]), (20, TEMPLATES["short"])])
    assert sorted(str(r.doc_id) for r in C.scan(docs, TEMPLATES).collect()) == ["20", "None"]
    assert C.scan(docs.limit(0), TEMPLATES).count() == 0 and C.scan(docs, {}).count() == 0


def test_telling_words():
    for t in C.TEMPLATES.values():
        s = C._shingles_of(t)
        left = [x for x in s if not set(x.split()) & set(C.telling_words(t))]
        assert len(left) < C.CONTAINED * len(s)


def held(text, templates):
    """Templates contained in the whole text."""
    w = C._words_of(text)
    have = {" ".join(w[k : k + n]) for n in range(1, C.SHINGLE + 1) for k in range(len(w) - n + 1)}
    want = {name: set(C._shingles_of(t)) for name, t in templates.items()}
    return {name for name, s in want.items() if len(s & have) >= C.CONTAINED * len(s)}


def test_every_pair_of_notices_is_found(spark, docs_of):
    texts = [f"{'x ' * (0, 7, 23, 44)[(i + k) % 4]}{a} {b}" for i, a in enumerate(C.TEMPLATES.values()) for k, b in enumerate(C.TEMPLATES.values())]
    texts += ["x " * at + C.TEMPLATES["apache-header"] for at in range(45)]
    got = {(r.doc_id, r.license_id) for r in C.scan(docs_of(list(enumerate(texts)))).collect()}
    assert got == {(i, name) for i, t in enumerate(texts) for name in held(t, C.TEMPLATES)}


def test_edited_notice_is_found_at_any_offset(spark, docs_of):
    w = C.TEMPLATES["mit-permission"].split()
    few = w[:15] + ["q"] * 8 + w[15:32] + ["q"] * 3 + w[32:]
    far = w[:25] + ["q"] * 80 + w[25:]
    apart = w[:25] + ["q"] * 900 + w[25:]
    texts = [" ".join(["x"] * at + x) for x in (few, far, apart) for at in range(45)]
    got = {(r.doc_id, r.n_matched, r.first_word) for r in C.scan(docs_of(list(enumerate(texts)))).collect() if r.license_id == "mit-permission"}
    assert got == {(at, 37, at) for at in range(45)} | {(45 + at, 41, at) for at in range(45)}


def test_license_lines_of_documents_are_covered(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(r"(?i)licensed|license\.|rights reserved"))
    want = {(r.doc_id, r.line.strip()) for r in lines.collect()}
    got = {}
    for r in C.scan(docs).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    ids = {"Apache": "apache-notice", "MIT": "mit-notice", "GNU": "gpl-3-line", "All": "all-rights-bare", "CC": "cc-by-nc-4.0-line"}
    assert len(want) >= 46
    for i, line in want:
        assert next(v for k, v in ids.items() if k in line) in got.get(i, ()), line


def test_variants_and_bare_reservations(spark, docs_of):
    rows = [
        (1, "Copyright 2020 by them. All rights reserved."), (2, "Licensed under CC BY-NC-ND 4.0."), (3, "licensed under CC BY 3.0"), (4, "under the GNU Affero General Public License, version 3 or later"),
        (5, "a b Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"), (6, "all rights, reserved here"), (7, "all rights are reserved"), (8, "All rights reserved"),
        (9, C.TEMPLATES["bsd-2-body"].replace("2. Redis", "\n * Redis")),
    ]
    got = {}
    for r in C.scan(docs_of(rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.license_id)
    assert got == {
        1: {"all-rights-bare"}, 2: {"cc-by-nc-nd-4.0-line"}, 3: {"cc-by-3.0-line"}, 4: {"agpl-3-line"}, 5: {"cc-by-nc-sa-4.0-name"}, 6: {"all-rights-bare"},
        8: {"all-rights-bare"}, 9: {"bsd-conditions", "bsd-2-body"},
    }


def test_query_equals_sql(spark):
    import duckdb

    from corvex.llm import queries

    sf = "/root/testdata/sf0.01"
    got = {tuple(r) for r in queries.op1_license_scan(spark, sf).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = set(con.execute(queries.SQL["op1_license_scan"]).fetchall())
    assert want and got == want and any(x[1] == "all-rights-bare" for x in got)
