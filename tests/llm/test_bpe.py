import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import bpe, token_counts

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


PIECES = st.lists(st.sampled_from([" ", "  ", "\n", " \n", "\t", "the", "Zażółć", "é", "1", "½", "!", "'s", "'ll", "_", "\x1c", "\x85", " ", "漢字", "🙂", "\0", "<|endoftext|>", "a" * 70]), max_size=30)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_equals_the_library_and_comes_back(codec, library, parts):
    text = "".join(parts)
    ids = codec.encode(text)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_every_sixth_character(codec, library):
    chars = [chr(c) for c in range(0, 0x110000, 6) if not 0xD800 <= c < 0xE000]
    texts = [f"a {c}b {c} 1{c}" for c in chars]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)] == library.encode_ordinary_batch(texts)


def test_long_words_and_full_cache(codec, library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 900)
    codec.room = 0
    random.seed(1)
    texts = ["".join(random.choice("abc") for _ in range(n)) for n in (63, 64, 65, 3000)] + ["one two three four five six seven"] * 2
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.encode_all(texts)] == library.encode_ordinary_batch(texts)


def test_long_stretches_are_not_remembered(library):
    """Text without spaces is one stretch; only the words in it stay, up to a bound in bytes."""
    c = bpe.Codec(PATH, P.PATTERN)
    random.seed(2)
    texts = ["".join(chr(random.randint(0x4E00, 0x9FA5)) + random.choice(["", "，", "。"]) for _ in range(3000)) for _ in range(20)]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_all(texts)] == library.encode_ordinary_batch(texts)
    assert max(map(len, [*c.known, *c.words]), default=0) <= bpe.SHORT
    assert sum(2 * len(k) + len(x) + 200 for d in (c.known, c.words) for k, x in d.items()) <= bpe.CACHE_BYTES


def test_edges(spark, docs_of, odd_rows, library):
    out = bpe.decode(bpe.encode(docs_of(odd_rows), PATH, P.PATTERN, carry=["doc_id", "text"]), PATH, P.PATTERN).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode_ordinary(r.text or "") and bytes(r.decoded).decode() == (r.text or "")
    assert bpe.encode(docs_of(odd_rows).limit(0), PATH, P.PATTERN).count() == 0


def test_higher_order_fold(spark, codec):
    words = [" the", "unbelievable", "é", " Straße", "a", "", "zzzzqq"]
    got = {r.word: r.ids for r in bpe.fold_words(spark.createDataFrame([(w,) for w in words], "word string"), codec.ranks).collect()}
    assert got == {w: np.frombuffer(codec.folder.fold([w.encode()])[0], "<u4").tolist() if w else [] for w in words}


@settings(max_examples=150, deadline=None)
@given(PIECES, st.lists(st.tuples(st.integers(-3, 200), st.integers(0, 12), PIECES), max_size=5))
def test_edited_counts(codec, parts, edits):
    text = "".join(parts)
    tree = token_counts.TokenTree(text, codec)
    for a, n, new in edits:
        new = "".join(new[:4])
        tree.edit(a, a + n, new)
        lo = min(max(a, 0), len(text))
        text = text[:lo] + new + text[min(max(a + n, lo), len(text)) :]
        assert tree.text() == text and tree.total() == len(codec.encode(text)) // 4


def test_count_query(spark, docs_of, odd_rows, library):
    docs = token_counts.with_sample_edits(docs_of(odd_rows))
    got = token_counts.count_edited(docs, PATH, P.PATTERN, carry=["doc_id", "text"]).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        t = r.text or ""
        assert r.n_tokens_before == len(library.encode_ordinary(t)) and r.n_edits == 3
        for a, b, new in token_counts.sample_edits(len(t), "" if r.doc_id is None else str(r.doc_id)):
            t = t[:a] + new + t[b:]
        assert r.n_tokens_after == len(library.encode_ordinary(t))


def test_an_edit_costs_a_bounded_piece_in_any_script(codec):
    random.seed(3)
    for text in ("".join(chr(random.randint(0x4E00, 0x9FA5)) + random.choice(["", "", "，"]) for _ in range(20_000)), "\n".join(f"word{i}" for i in range(8_000)), "word " * 9_000):
        tree = token_counts.TokenTree(text, codec)
        tree.edit(len(text) // 2, len(text) // 2 + 3, "new!")
        assert tree.reencoded < 1000
        assert tree.total() == len(codec.encode(text[: len(text) // 2] + "new!" + text[len(text) // 2 + 3 :])) // 4


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id bigint, text string, ids string, n_edits int")
    assert sorted(bpe.encode(docs, PATH, P.PATTERN).columns) == ["doc_id", "ids", "n_edits", "text"]
    r = token_counts.count_edited(token_counts.with_sample_edits(docs), PATH, P.PATTERN)
    assert r.first().n_edits == 3 and r.first().ids == "mine"
