"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

import verify
from corvex.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, name, monkeypatch):
    monkeypatch.setattr(verify, "entry", registry)
    said = verify.compare(spark, SF, name)
    assert said.startswith(("ok", "rows only")), said


@pytest.mark.parametrize("name", ["search_or_fallback", "search_bm25_top10"])
def test_expansions_beside_the_word(spark, name, tmp_path, monkeypatch):
    """A word of the vocabulary with 61 others that begin with it: 60 of these count, the last by order does not."""
    others = [f"attion{i:03d}q" for i in range(61)]
    texts = ["attion thanedble threa", " ".join(others[:59]), others[59], others[60], f"attion {others[59]}", "other words"]
    rows = [(i, f"heading\n{t}", "en", "src0", len(t)) for i, t in enumerate(texts)]
    for t in verify.TABLES:
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    (tmp_path / "documents.parquet").unlink()
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").toPandas().to_parquet(tmp_path / "documents.parquet")
    monkeypatch.setattr(verify, "entry", registry)
    assert sorted(r.id for r in registry.queries()[name](spark, str(tmp_path)).collect()) == [0, 1, 2, 4]
    assert verify.compare(spark, str(tmp_path), name) == "ok: 4"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["id", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
