import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import corpus_pipeline as C
from corvex.llm import bpe, quality
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_decontam import plain
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_suffix_dedup import brute as brute_bytes

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    tests = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(r.rejects(quality.TextStats(t)) for r in quality.RULES)]
    low = brute_components([(i, brute_print(t)) for i, t in rows])
    rows = [(i, t) for (i, t), c in zip(rows, low) if i == c]
    rows = [(i, b.decode("utf-8", "ignore")) for i, b in brute_bytes(rows)]
    keep = []
    for i, t in rows:
        hit, _ = brute_hits(t, [(i, x) for i, x in tests if set(plain(x)) & set(plain(t))], 13) if len(plain(t)) else (set(), None)
        if not (hit and 20 * len(hit) >= len(plain(t))):
            keep.append((i, t))
    ranks = bpe.read_ranks(P.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {i: enc.encode_ordinary(t) for i, t in keep}
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in C.run(spark, SF).collect()}
    assert got == want and len(got) > 50


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_last_stage_decodes(spark):
    docs = spark.createDataFrame([(1, "Añ 🙂 some text", "en", "s"), (2, "", "en", "s"), (3, None, "en", "s")], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: r.decoded_sha256 for r in C.byte_bpe(spark, docs, SF).collect()}
    assert got == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t, *_ in docs.collect()}


def test_stages_on_odd_rows_and_columns_of_their_own_names(spark, odd_rows):
    """Nulls, empty and long texts, ties, repeated rows, and user columns named like the operators' results."""
    full = [(i, t, "mine", 2, "own", False) for i, t in odd_rows]
    docs = spark.createDataFrame(full, "doc_id bigint, text string, kept string, n_removed int, spans string, contaminated boolean")
    count = lambda xs: sorted(map(str, xs))
    out = {}
    for name, stage in C.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.schema == docs.schema
        rows = got.collect()
        assert all((r.kept, r.n_removed, r.spans, r.contaminated) == ("mine", 2, "own", False) for r in rows)
        out[name] = [(r.doc_id, r.text) for r in rows]
    good = [(i, t) for i, t in odd_rows if not any(r.rejects(quality.TextStats(t)) for r in quality.RULES)]
    assert count(out["quality_rules"]) == count(good)
    low = brute_components([(i, brute_print(t)) for i, t in odd_rows])
    first = {(i, t) for (i, t), c in zip(odd_rows, low) if i is None or i == c}
    assert count(out["simhash_near_dedup"]) == count(first)
    cut = [(i, b.decode("utf-8", "ignore")) for i, b in brute_bytes(odd_rows)]
    assert count((i, t or "") for i, t in out["suffix_array_dedup"]) == count(cut)
    assert count(out["decontamination"]) == count(odd_rows)
    assert C.byte_bpe(spark, docs.select("text"), SF).count() == len(odd_rows)


def test_run_keeps_one_table(spark, tmp_path):
    import os

    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    before = set(os.listdir(top))
    C.run(spark, SF).count()
    made = [d for d in set(os.listdir(top)) - before if d.startswith("pipeline-")]
    assert len(made) == 1 and os.listdir(f"{top}/{made[0]}") == [f"3-{C.STAGES[3][0]}"]
