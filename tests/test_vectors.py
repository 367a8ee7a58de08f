import pytest

from corvex.streaming import vectors as T

NOTES = "permalink string, title string, description string, text string, removed boolean, t bigint"


def marked(texts):
    """Each call gives another vector, so that a vector that stays was not made again."""
    import random

    return [[1.0 + random.random(), float(len(t))] for t in texts]


def step(spark, rows, n, path, embedder=marked, **kw):
    T.apply_batch(spark.createDataFrame(rows, NOTES), n, path, embedder, **kw)
    return {r.key: tuple(r.vector) for r in T.stored(spark, path, n).collect()}


def test_only_what_changed_is_embedded(spark, tmp_path):
    path = str(tmp_path / "v")
    two = "intro\n\n## A\nfirst\n## B\nsecond\n"
    a = step(spark, [("x", "X", None, two, False, 1), ("y", "Y", "d", "why", None, 1), ("z", None, None, None, False, 1), (None, "n", None, "n", False, 1)], 0, path)
    assert set(a) == {"x#0.0", "x#1.0", "x#2.0", "y#0.0"} and all(abs(v[0] ** 2 + v[1] ** 2 - 1) < 1e-9 for v in a.values())
    b = step(spark, [("x", "X", None, two.replace("second", "other"), False, 2), ("x", "X", None, "older", False, 1), ("w", "W", None, "new", False, 2)], 1, path)
    assert {k for k in b if b[k] == a.get(k)} == {"x#0.0", "x#1.0", "y#0.0"} and set(b) == set(a) | {"w#0.0"}
    again = step(spark, [("x", "X", None, two.replace("second", "other"), False, 2), ("w", "W", None, "new", False, 2)], 1, path)
    assert set(again) == set(b) and again["x#0.0"] == a["x#0.0"]  # the same batch once more
    c = step(spark, [("x", "X", None, "intro", False, 3), ("y", None, None, None, True, 3)], 2, path)
    assert set(c) == {"x#0.0", "w#0.0"} and c["w#0.0"] == again["w#0.0"]
    assert step(spark, [("x", "X", None, "intro", True, 4), ("w", "W", None, "", False, 4)], 3, path) == {}
    assert step(spark, [], 4, path) == {} and set(step(spark, [("x", "X", None, "back", False, 5)], 5, path)) == {"x#0.0"}


def test_other_buckets_stay_where_they_are(spark, tmp_path):
    path = str(tmp_path / "v")
    step(spark, [(f"n{i}", "T", None, f"text {i}", False, 1) for i in range(40)], 0, path, buckets=8)
    got = step(spark, [("n3", "T", None, "changed", False, 2)], 1, path, buckets=8)
    assert sorted(T.manifest(spark, path, 1).values()) == [0] * 7 + [1] and len(got) == 40
    with pytest.raises(ValueError):
        step(spark, [], 2, path, buckets=0)


def test_no_vector_is_asked_for_again(spark, tmp_path):
    path = str(tmp_path / "v")
    row = [("a", "A", None, "one", False, 1)]
    assert step(spark, row, 0, path, lambda ts: [[] for _ in ts]) == {} and set(step(spark, row, 1, path)) == {"a#0.0"}


def test_a_stream_goes_on_after_a_stop(spark, tmp_path):
    src, path, check = (str(tmp_path / k) for k in ("src", "v", "check"))
    put = lambda *rows: spark.createDataFrame(rows, NOTES).coalesce(1).write.mode("append").parquet(src)
    run = lambda: T.follow(spark.readStream.schema(NOTES).parquet(src), path, check, marked).awaitTermination()
    put(("a", "A", None, "one", False, 1), ("b", "B", None, "two", False, 1))
    run()
    first = {r.key: tuple(r.vector) for r in T.stored(spark, path, 0).collect()}
    put(("b", "B", None, "three", False, 2))
    run()
    second = {r.key: tuple(r.vector) for r in T.stored(spark, path, 1).collect()}
    assert set(first) == set(second) == {"a#0.0", "b#0.0"} and first["a#0.0"] == second["a#0.0"] and first["b#0.0"] != second["b#0.0"]


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    from corvex.plans.registry import queries

    rows = [(c, t, "user", f"turn {t} of {c}") for c in range(5) for t in range(3)]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert queries()["stream_vectors"](spark, str(tmp_path)).count() == 15
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert queries()["stream_vectors"](spark, str(tmp_path / "none")).count() == 0
