import math
from collections import Counter

import numpy as np
import pytest

from corvex.llm import lm


def brute(rows, order=lm.ORDER, priors=lm.PRIORS):
    c = Counter()
    line = lambda t: [lm.END, *lm.tokens(t), lm.END]
    for i, t in rows:
        if not lm.held_out(i):
            w = line(t)
            for p in range(1, len(w)):
                c.update(tuple(w[a : p + 1]) for a in range(max(0, p + 1 - order), p + 1))
    single = {k[0]: n for k, n in c.items() if len(k) == 1}
    n = sum(single.values())

    def below(g):  # log P of the last word after those before it
        if len(g) == 1:
            return (single.get(g[0], 0) + 1) / (n + len(single) + 1)
        h, prior = c[g[:-1]], priors[min(len(g) - 1, len(priors)) - 1]
        return (c[g] + prior * below(g[1:])) / (h + prior) if h else below(g[1:])

    out = []
    for i, t in rows:
        w = line(t)
        base = sum(math.log10(below((v,))) for v in w[1:])
        score = sum(math.log10(below(tuple(w[max(0, p + 1 - order) : p + 1]))) for p in range(1, len(w)))
        out.append((str(i), lm.held_out(i), len(w) - 1, sum(1 for v in w[1:] if v in single), n, round(base, 6), round(score, 6)))
    return sorted(out)


def check(docs, rows, **how):
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, carry=["doc_id"], **how).collect()]
    assert sorted(got) == brute(rows, **how)


def test_edges(spark, docs_of, odd_rows):
    check(docs_of(odd_rows), odd_rows)
    assert lm.score(docs_of(odd_rows).limit(0)).count() == 0


MIXED = [(i, " ".join(f"W{(i * i + j * j) % 13}" for j in range(i % 9))) for i in range(80)] + [(k, " ".join(f"w{x * x * k % 17}" for x in range(3000))) for k in (90, 91, 92)]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_orders(spark, docs_of, order):
    check(docs_of(MIXED), MIXED, order=order)


def test_lanes_change_nothing():
    c = lm.Chunk([str(i) for i, _ in MIXED], [t for _, t in MIXED])
    model = lm.Automaton(c.levels, [x.seen for x in c.levels], int(c.levels[0].seen.sum()), int((c.levels[0].seen > 0).sum()))
    whole = model.read(c.flat[1:], c.size, 1 << 20)
    for lane in (2, 7, 1000):
        assert np.allclose(model.read(c.flat[1:], c.size, lane), whole, atol=1e-9)


def test_no_training(spark, docs_of):
    i = next(k for k in range(100) if lm.held_out(k))
    r = lm.score(docs_of([(i, "a b")])).first()
    assert (r.n_known, r.train_tokens, r.base_score, r.score) == (0, 0, 0.0, 0.0)


def test_known_words_in_unknown_order(spark, docs_of):
    held = [k for k in range(100) if lm.held_out(k)]
    rows = [(next(k for k in range(100) if not lm.held_out(k)), "a b c")] + [(k, "c b a") for k in held]
    check(docs_of(rows), rows)


def test_ids_of_text_and_clashing_columns(spark):
    docs = spark.createDataFrame([("x", "a b c", "own", 1.5), (None, "a b", "own", 2.5), (None, None, None, None)], "doc_id string, text string, held_out string, score double")
    got = lm.score(docs, carry=docs.columns)
    assert got.columns == ["doc_id", "text", *[n for n, _ in lm.FIELDS]] and got.count() == 3


def test_probabilities_sum_to_one():
    i = next(k for k in range(100) if not lm.held_out(k))
    c = lm.Chunk([str(i)] * 3, ["a b a b c", "b a", "a a a b d"])
    train = [x.seen for x in c.levels]
    model = lm.Automaton(c.levels, train, int(train[0].sum()), c.n)
    unknown = 1 / (train[0].sum() + c.n + 1)
    for state in {model.start, *model.target.tolist()}:
        words = np.arange(c.n)
        weight, _ = model.step(np.full(c.n, state), words)
        left, s = unknown, state  # of the one unknown class, by failure arcs alone
        while s:
            left, s = left * 10 ** model.fail_weight[s], model.fail[s]
        assert abs((10.0**weight).sum() + left - 1) < 1e-12
