import itertools
import random

import numpy as np

from corvex.llm import langid as L

PARTS = {"en": ["the", "ing", "th", "er", "wh", "sh"], "fr": ["eau", "é", "ou", "que", "ch", "ux"], "de": ["sch", "ung", "ei", "pf", "ß", "z"]}


def text(lang, n):
    return " ".join("".join(random.choice(PARTS[lang]) for _ in range(random.randint(1, 4))) for _ in range(n))


def rows(n):
    random.seed(4)
    return [(i, text(g := random.choice(sorted(PARTS)), random.randint(5, 60)), g) for i in range(n)]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    f = L.Field(["a", "b"], np.zeros((1, 2)), {}, np.zeros((3, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    seqs = [rng.normal(size=(n, 2)) for n in (3, 1, 5)]
    for e, got in zip(seqs, f.marginals(seqs)):
        p = np.zeros_like(e)
        for path in itertools.product((0, 1), repeat=len(e)):
            s = f.first[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(f.moves[x, y] for x, y in zip(path, path[1:]))
            for i, y in enumerate(path):
                p[i, y] += np.exp(s)
        assert np.allclose(got, p / p.sum(axis=1, keepdims=True))


def enumerate_paths(f, e):
    """Labels' probabilities by word, over all paths, from emissions."""
    p = np.zeros_like(e)
    for path in itertools.product(range(len(f.labels)), repeat=len(e)):
        s = f.first[path[0]] + sum(e[i, y] for i, y in enumerate(path)) + sum(f.moves[x, y] for x, y in zip(path, path[1:]))
        for i, y in enumerate(path):
            p[i, y] += np.exp(s)
    return p / p.sum(axis=1, keepdims=True)


def test_predictions_equal_enumeration(spark, docs_of):
    """Whole predictions against features added up one by one and all paths of labels."""
    f = L.learn(spark.createDataFrame(rows(60), "doc_id bigint, text string, lang string"))
    odd = [(1, "the eau"), (2, "sch the ux the que"), (3, "½"), (4, None), (5, "THE 7 ing"), (6, "zzz"), (7, "eau eau")]
    got = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in L.identify(docs_of(odd), f).collect()}
    for i, t in odd:
        ws = [w for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()] if t != "½" else []
        e = []
        for w in ws:
            idx, _ = L.grams([w])
            e.append(sum((f.weights[b] for b in idx), np.zeros(3)) + f.lexical[f.lexicon.get(w, 3)])
        mean = enumerate_paths(f, np.array(e)).mean(axis=0) if ws else None
        assert got[i] == ((f.labels[int(mean.argmax())], round(mean.max(), 9)) if ws else ("und", 0.0))


def test_long_texts_in_blocks():
    rng = np.random.default_rng(2)
    f = L.Field(["a", "b", "c"], np.zeros((1, 3)), {}, np.zeros((4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    e, ids = rng.normal(size=(9, 3)), rng.integers(0, 9, 50)
    whole = f.marginals([e[ids]])[0]
    for size in (1, 7, 50, 64):
        assert np.allclose(np.concatenate(list(f.blocks(ids, e, size))[::-1]), whole)


def test_batches_and_blocks_change_nothing(spark, docs_of, monkeypatch):
    f = L.learn(spark.createDataFrame(rows(60), "doc_id bigint, text string, lang string"))
    some = docs_of([(i, t) for i, t, _ in rows(40)] + [(90, "the eau " * 900)])
    want = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(some, f, carry=["doc_id"]).orderBy("doc_id").collect()]
    texts = [r.text for r in some.collect()]
    monkeypatch.setattr(L, "CELLS", 150)
    got = [(r.doc_id, r.lang_pred, round(r.score, 9)) for r in L.identify(some, f, carry=["doc_id"]).orderBy("doc_id").collect()]
    assert got == want and len(texts) == 41


def test_letters():
    assert L.words("½ ² Ⅷ ① 7_") == []
    assert L.words("हिन्दी भाषा, don't 東京2") == ["हिन्दी", "भाषा", "don", "t", "東京"]


def test_columns_of_its_own_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "the ing", "en", "x", 5)], "doc_id bigint, text string, lang string, lang_pred string, score int")
    r = L.identify(docs, L.learn(docs.withColumn("doc_id", docs.doc_id * 0)))
    assert sorted(r.columns) == ["doc_id", "lang", "lang_pred", "score", "text"] and r.first().lang_pred == "en"


def test_held_out_accuracy_and_switching(spark):
    data = rows(300)
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    f = L.learn(docs)
    got = {r.doc_id: r for r in L.identify(docs, f, carry=["doc_id"]).collect()}
    held = [(i, g) for i, _, g in data if L.held_out(i)]
    assert sum(got[i].lang_pred == g for i, g in held) >= 0.97 * len(held)
    mixed = text("fr", 30) + " " + text("de", 30)
    r = L.identify(spark.createDataFrame([(1, mixed)], "doc_id bigint, text string"), f, spans=True).first()
    assert [s.lang for s in r.spans] == ["fr", "de"] and mixed[r.spans[0].start : r.spans[0].end].count(" ") in (28, 29, 30)


def test_edges(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    f = L.learn(docs)
    got = L.identify(docs, f, carry=["doc_id", "text"]).collect()
    assert len(got) == len(odd_rows) and f.labels == ["en"]
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred, r.score > 0) == (("en", True) if letters else ("und", False)) and 0 <= r.score <= 1
    none = L.learn(docs_of(odd_rows, lang=None))
    assert none.labels == [] and {r.lang_pred for r in L.identify(docs, none).collect()} == {"und"}
    assert L.identify(docs.limit(0), f).count() == 0


def test_languages_of_long_documents_are_learned(spark):
    random.seed(5)
    data = [(i, text("en", 40), "en") for i in range(30)] + [(100 + i, text("fr", 5000), "fr") for i in range(8)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    assert all(len(t) > L.SAMPLE_CHARS for _, t, g in data if g == "fr")
    f = L.learn(docs)
    assert f.labels == ["en", "fr"] and {r.lang_pred for r in L.identify(docs.where("lang = 'fr'"), f).collect()} == {"fr"}


def test_rare_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(L, "fit", lambda texts, tags: sorted(set(tags)))
    docs = spark.createDataFrame([(i, f"word{i}", f"l{i:03}") for i in range(340)], "doc_id bigint, text string, lang string")
    want = [f"l{i:03}" for i in range(340) if not L.held_out(i)]
    assert len(want) > 200 and L.learn(docs) == want
