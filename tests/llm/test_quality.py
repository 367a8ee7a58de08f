from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import quality as Q


def brute_repeats(words):
    hit = set()
    for i in range(len(words) - 2):
        if any(words[j : j + 3] == words[i : i + 3] for j in range(len(words) - 2) if j != i):
            hit |= {i, i + 1, i + 2}
    return len(hit)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25))
def test_repeat_words(ws):
    assert Q.TextStats(" ".join(ws)).n_repeat_words == brute_repeats(ws)


def test_measures():
    s = Q.TextStats("a#b  c d\n\nx\nx\n \nx\u0085")
    assert (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines) == (5, 10, 1, 1)


def test_edges(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    got = Q.cascade(docs, carry=["doc_id", "source"], measures=True).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert not by[1].kept and by[1].n_words == 0 and not by[2].kept and by[0].kept and not by[9].kept and by[9].base_failed
    assert Q.cascade(docs.limit(0)).count() == 0
    kept = Q.cascade(docs)  # a column of the input named kept is replaced
    assert kept.columns.count("kept") == 1 and kept.where("kept").count() > 0


def test_order_changes_no_verdict(spark, docs_of, odd_rows):
    docs = docs_of(odd_rows)
    a = {r.doc_id: r.kept for r in Q.cascade(docs, carry=["doc_id"]).collect()}
    b = {r.doc_id: r.kept for r in Q.cascade(docs, carry=["doc_id"], rules=Q.RULES[::-1]).collect()}
    assert a == b and {e.name for e in Q.estimate(docs)} == {r.name for r in Q.RULES}
