import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvex.llm import whitening as W


def table(spark, rows, parts=3):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(parts)


def plain(vectors, k=32):
    """n, S, x, components, variances by numpy over the whole table."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)) + 1_000_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return n, s, x, v[:, ::-1].T[:k], e[::-1]


@pytest.mark.parametrize("n,d,parts,block", [(400, 12, 1, 64), (1000, 40, 20, 32), (300, 64, 70, 8), (50, 33, 9, 1000)])
def test_equals_numpy_on_the_whole_table(spark, monkeypatch, n, d, parts, block):
    monkeypatch.setattr(W, "BLOCK", block)
    rng = np.random.default_rng(n)
    v = (rng.normal(size=(n, d)) * np.linspace(0.5, 4, d) + rng.normal(size=d) * 30).astype(np.float32)
    df = table(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)], parts)
    m = W.fit(df)
    got = {r.vec_id: r for r in W.transform(df, m).collect()}
    count, s, x, comps, var = plain(v)
    assert m.n == count == len(got) and m.sums == s.astype(int).tolist()
    k = min(32, d)
    assert np.allclose(m.values, var[:k], rtol=1e-9) and np.allclose(m.share, var[:k] / var.sum(), rtol=1e-9)
    xi = x.astype(int)
    for i in range(n):
        assert got[i].deviation == sum((count * int(a) - int(b)) ** 2 for a, b in zip(xi[i], s.astype(int)))
        mine, want = np.array(got[i].whitened), comps @ (x[i] - s / count) / np.sqrt(var[:k])
        sign = np.sign((m.vectors * comps).sum(1))
        assert np.allclose(mine * sign, want, atol=1e-6)
    assert W.identity_error(df, m) < 1e-9


def test_merging_keeps_every_dimension():
    rng = np.random.default_rng(1)
    x = rng.integers(999_000, 1_001_000, (700, 20))
    x[:, 3] = 1_000_000 + rng.integers(0, 2, 700)  # next to no variance beside the others
    parts = [W.Part.of(x[a : a + 50]) for a in range(0, 700, 50)]
    whole = W.Part.of(x)
    got = parts[0]
    for p in parts[1:]:
        got = got.merged(p)
    assert got.n == 700 and got.sums == whole.sums and got.rows.shape == (20, 20)
    a, b = np.linalg.svd(got.rows)[1], np.linalg.svd(whole.rows)[1]
    assert np.allclose(a, b, rtol=1e-12, atol=1e-9 * b[0])


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    good = [(i, rng.normal(size=5).tolist(), 1) for i in range(60)]
    odd = [
        (100, None, 1), (101, [1.0, None, 2.0, 3.0, 4.0], 1), (102, [1.0, math.nan, 2.0, 3.0, 4.0], 1), (103, [math.inf, 1.0, 2.0, 3.0, 4.0], 1),
        (104, [], 1), (105, [1.0, 2.0], 1), (106, [1e30] * 5, 1), (0, good[0][1], 2), (None, good[1][1], 3),
    ]
    df = table(spark, good + odd).withColumn("whitened", F.lit("mine"))
    m = W.fit(df)
    out = W.transform(df, m).collect()
    assert m.n == 62 == len(out) and {r.vec_id for r in out} == {*range(60), None}
    assert set(out[0].asDict()) == {"vec_id", "embedding", "label", "deviation", "whitened"}
    assert W.identity_error(df, m) < 1e-9


def test_without_variance_and_without_rows(spark):
    df = table(spark, [(i, [0.5, -1.0, 2.0], 0) for i in range(7)])
    m = W.fit(df)
    assert all(r.whitened == [None] * 3 and r.deviation == 0 for r in W.transform(df, m).collect()) and m.share.tolist() == [0, 0, 0]
    assert W.identity_error(df, m) is None
    line = table(spark, [(i, [float(i), 2.0 * i, 1.0], 0) for i in range(7)])
    m = W.fit(line)
    assert [[x is None for x in r.whitened] for r in W.transform(line, m).collect()] == [[False, True, True]] * 7
    assert W.identity_error(line, m) < 1e-9
    assert W.fit(df.limit(0)) is None and W.transform(df.limit(0), None).count() == 0 and W.transform(df, None).count() == 0


def test_large_numbers_stay_exact(spark):
    v = [[2.0**33, -(2.0**33)], [-(2.0**33), 5.0], [1.0, 2.0**32]] * 4000
    df = table(spark, [(i, x, 0) for i, x in enumerate(v)])
    m = W.fit(df)
    n, s = len(v), [sum(int(64 * x[k]) + 1_000_000 for x in v) for k in (0, 1)]
    assert m.sums == s
    for r in W.transform(df, m).where("vec_id < 3").collect():
        want = sum((n * (int(64 * a) + 1_000_000) - b) ** 2 for a, b in zip(v[r.vec_id], s))
        assert r.deviation == (want if want < 2**63 else None)


def test_query(spark, tmp_path):
    from corvex.llm.queries import op11_whitening

    rng = np.random.default_rng(3)
    v = rng.normal(size=(80, 34)).astype(np.float32)
    table(spark, [(i, x.tolist(), 0) for i, x in enumerate(v)]).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = op11_whitening(spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = out.collect()
    assert len(rows) == 80 * 32 and {r.component for r in rows} == set(range(1, 33)) and {r.n for r in rows} == {80} and max(r.identity_error for r in rows) < 1e-9
    _, _, _, _, var = plain(v)
    assert all(abs(r.explained / (var[r.component - 1] / var.sum()) - 1) < 1e-9 for r in rows)
    table(spark, []).write.parquet(f"{tmp_path}/none/embeddings.parquet")
    assert op11_whitening(spark, f"{tmp_path}/none").count() == 0
