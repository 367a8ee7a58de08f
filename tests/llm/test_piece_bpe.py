import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corvex.llm import piece_bpe as B

PATH = P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


PARTS = st.lists(st.sampled_from([" ", "  ", "    ", "\n", "\t", "the", "Zażółć", "é", "é", "12", "½", "!!", "====", "_", "▁", " ", "漢字", "🙂", "\0", "<s>", "<0x41>", "aaaa", "x" * 70, "﷐", "𓀀"]), max_size=20)


@settings(max_examples=300, deadline=None)
@given(PARTS)
def test_equals_the_library(codec, library, parts):
    text = "".join(parts)
    ids = codec.encode(text)
    assert ids == library.encode(text)
    assert codec.decode(ids) == library.decode(ids) == codec.decode_all(pa.array([ids], pa.list_(pa.int32()))).to_pylist()[0]


def test_pieces_next_to_each_other(codec, library):
    """Texts made of pieces, side by side, so that most pairs of pieces are tried."""
    rng = random.Random(1)
    texts = ["".join(rng.choice(codec.model.pieces[259:]) for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    assert codec.encode_all(pa.array(texts)).to_pylist() == library.encode(texts)


def test_all_pieces_fold_to_themselves_or_are_never_used(codec, library):
    for piece in random.Random(2).sample(sorted(codec.rank), 3000):
        assert (piece in codec.folds) == (codec._fold(piece) is not None)


def test_long_words_by_the_table_alone(codec, library):
    rng = random.Random(3)
    for text in ("".join(chr(rng.randint(0x4E00, 0x9FA5)) + rng.choice(["", "，", "aa"]) for _ in range(4000)), "ab" * 5000, "=" * 3001, "x" * 200_000):
        ids = codec.encode(text)
        assert ids == library.encode(text) and codec.decode(ids) == text
        word = B.MARK + text[:40]
        assert codec.encode_words([word, ""]) == [codec.encode_word(word), b""]


def test_table_of_prefixes(codec, library):
    """The table's entry for each prefix is the last piece of the library's encoding of that prefix."""
    word = B.MARK + "unbelievableness"
    table = codec.last_pieces(word)
    assert table == [library.encode(word[1 : k + 1], out_type=str)[-1] if k else B.MARK for k in range(len(word))]


def test_any_ids_decode_as_the_library_does(codec, library):
    rng = random.Random(4)
    rows = [[rng.choice([rng.randint(0, 31_999), rng.randint(0, 300), rng.randint(128, 260), 28705]) for _ in range(rng.randint(0, 6))] for _ in range(6000)]
    want = library.decode(rows)
    assert [codec.decode(r) for r in rows] == want
    for size in (1, 2, 7, 6000):
        assert [x for k in range(0, 600 if size == 1 else 6000, size) for x in codec.decode_all(pa.array(rows[k : k + size], pa.list_(pa.int32()))).to_pylist()] == want[: 600 if size == 1 else 6000]
    assert codec.decode([40_000, -1]) == codec.decode([0, 0]) and codec.decode(None) == ""
    assert codec.decode_all(pa.array([None, [], [264, 40_000]], pa.list_(pa.int32()))).to_pylist() == ["", "", codec.decode([264, 0])]


def test_cache_is_bounded(library, monkeypatch):
    monkeypatch.setattr(B, "CACHE_BYTES", 2000)
    monkeypatch.setattr(B, "SLOT_BITS", 4)
    c = B.Codec(PATH)
    texts = [f"word{i} and another{i * 7} one" for i in range(300)]
    for at in range(0, 300, 20):
        assert c.encode_all(pa.array(texts[at : at + 20])).to_pylist() == library.encode(texts[at : at + 20])
    assert sum(2 * len(w) + len(x) + 160 for w, x in c.known.items()) <= 20 * 4 * 200


def test_every_separator_taken(codec, library):
    text = " a ".join(B.SEPARATORS)
    assert codec.encode_all(pa.array([text, "  b c"])).to_pylist() == library.encode([text, "  b c"])


def test_operator(spark, docs_of, odd_rows, library):
    out = B.decode(B.encode(docs_of(odd_rows), PATH), PATH).collect()
    assert len(out) == len(odd_rows)
    for r in out:
        assert r.ids == library.encode(r.text or "") and r.decoded == library.decode(r.ids)
    assert B.decode(B.encode(docs_of(odd_rows).limit(0), PATH), PATH).count() == 0
    clash = spark.createDataFrame([(1, "a b", "mine", 7)], "doc_id bigint, text string, ids string, decoded int")
    r = B.decode(B.encode(clash, PATH), PATH).first()
    assert r.ids == library.encode("a b") and r.decoded == "a b" and len(r) == 4


def test_query(spark, tmp_path, odd_rows, library):
    from corvex.llm.queries import op12_piece_bpe

    rows = [(i, t) for i, (_, t) in enumerate(odd_rows)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = dict(rows)
    for r in op12_piece_bpe(spark, str(tmp_path)).collect():
        ids = library.encode(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_other_models_are_refused(tmp_path):
    raw = open(PATH, "rb").read()
    for old, new in ((b"\x18\x02\x20\x80\xfa\x01", b"\x18\x01\x20\x80\xfa\x01"),):  # a unigram model
        assert raw.count(old) == 1
        (tmp_path / "m.model").write_bytes(raw.replace(old, new))
        with pytest.raises(ValueError, match="BPE"):
            B.Model(str(tmp_path / "m.model"))
