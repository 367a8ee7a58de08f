import shutil

import pytest
from pyspark.sql import functions as F

from corvex.operators import usage as U
from corvex.streaming import activity as A

SCHEMA = "type string, actor bigint, id bigint, t bigint, source string, word string"


@pytest.fixture
def run(spark, tmp_path):
    def go(rows, query, mode="append"):
        src = str(tmp_path / "in")
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("overwrite").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src).withColumn("ts", F.timestamp_millis("t"))
        q = query(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        got = [tuple(r) for r in spark.table("out").collect()]
        shutil.rmtree(tmp_path / "ck")
        return got

    return go


def ev(kind, actor, note, t, source="x", word=None):
    return (kind, actor, note, t, source, word)


def test_daily_counters_equal_the_batch(spark, run):
    day = 86_400_000
    rows = [ev(k, 1, n, d * day + n) for d in range(3) for n in (1, 2) for k in ("read", "search", "read")]
    got = run(rows, A.daily_counters, "complete")
    batch = U.daily_counters(spark.createDataFrame(rows, SCHEMA).withColumn("day", F.to_date(F.timestamp_millis("t"))))
    assert sorted(got) == sorted(tuple(r) for r in batch.select("day", "id", "search", "read", "write").collect())


def test_rate_limit_is_anchored(run):
    rows = [ev("read", 1, i, 500 + i) for i in range(40)] + [ev("read", 1, 99, 1499), ev("read", 1, 100, 1500)]
    got = {r[1] for r in run(rows, A.rate_limit)}
    assert got == set(range(30)) | {100}


def test_dedup_consumes_once(run):
    rows = [ev("write", 1, 7, 1000, "reported"), ev("write", 1, 7, 9000, "disk"), ev("write", 1, 7, 9500, "disk"), ev("write", 1, 7, 60_000, "disk")]
    assert sorted(r[2] for r in run(rows, A.dedup_writes)) == [1000, 9500, 60_000]


def test_dedup_after_a_change_on_disk(run):
    rows = [ev("write", 1, 7, 1000, "disk"), ev("write", 1, 7, 9000, "reported"), ev("write", 1, 7, 9500, "reported"), ev("write", 1, 7, 9600, "disk"), ev("write", 1, 7, 9700, "disk")]
    assert sorted(r[2] for r in run(rows, A.dedup_writes)) == [1000, 9500, 9700]


def test_rate_limit_of_all_and_of_each_source(run):
    rows = [ev("read", 1, i, 500 + i, "xy"[i % 2]) for i in range(80)]
    assert len(run(rows, A.rate_limit)) == 30 and len(run(rows, lambda s: A.rate_limit(s, "source"))) == 60


def test_ring_outlines_and_known_words(spark, run):
    rows = [ev("read", 1, i, 100 - i) for i in range(14)]
    assert run(rows, lambda s: A.recent_ring(s, "actor")) == [(1, list(range(9, -1, -1)))]
    reads = [ev("read", 1, 5, t, word=w) for t, w in ((1, None), (2, "sec"), (3, None), (4, None))]
    got = run(reads, lambda s: A.outlines_first(s.select(F.col("actor").alias("session"), "id", "t", F.lit(900).alias("tokens"), F.col("word").alias("section")), 500))
    assert [r[3] for r in sorted(got, key=lambda r: r[2])] == ["outline", "section", "full", "outline"]
    futile = spark.createDataFrame([("a", "f1"), ("b", "f0")], "word string, fingerprint string")
    searches = spark.createDataFrame([("search", "a"), ("search", "b")], "type string, word string")
    assert [r.word for r in A.known_futile(searches, futile, "f1").collect()] == ["a"]
    aliases = spark.createDataFrame([("a", 3, 1), ("a", 4, 2)], "word string, note int, count int")
    assert {(r.word, r.alias) for r in A.inject_aliases(searches, aliases).collect()} == {("a", 4), ("b", None)}


def test_what_was_shown_teaches_nothing(run):
    rows = [ev("search", 1, 0, 0, word="foo"), ev("read", 1, 5, 10), ev("search", 2, 0, 0, word="foo"), ev("read", 2, 6, 10)]
    assert run(rows, lambda s: A.learned_aliases(s.withColumn("results", F.array(F.lit(5).cast("bigint"))))) == [("foo", 6, 10)]


def test_waiting_for_time(spark, tmp_path):
    """Episodes and idle notes come out once the watermark has passed, and not before."""
    def at(k, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def go(query, name):
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")).withColumn("ts", F.timestamp_millis("t"))
        query(stream).writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r)[:4] for r in spark.read.parquet(str(tmp_path / name)).collect())

    at(0, [ev("search", 1, 0, 1), ev("read", 1, 5, 50_000), ev("search", 1, 0, 60_000), ev("write", 1, 9, 1)])
    assert go(A.closed_episodes, "e") == [] and go(A.idle_notes, "i") == []
    at(1, [ev("read", 2, 5, 400_000), ev("write", 2, 8, 400_000)])
    go(A.closed_episodes, "e")
    at(2, [ev("read", 2, 5, 4_000_000), ev("write", 2, 7, 4_000_000)])
    assert go(A.closed_episodes, "e") == [(1, 1, 50_000, 49_999), (1, 60_000, None, None)]
    go(A.idle_notes, "i")
    at(3, [ev("read", 2, 5, 4_100_000), ev("write", 3, 6, 4_100_000)])
    assert [r[0] for r in go(A.idle_notes, "i")] == [8, 9]


def test_queue_and_verdicts(spark):
    c = spark.createDataFrame([(i, 100 - i) for i in range(14)], "id int, due_t int")
    q = spark.createDataFrame([(13, 5), (12, 4)], "id int, queued_t int")
    assert [r.id for r in A.sweep(c, q).collect()] == [11, 10, 9, 8, 7, 6, 5, 4, 3, 2] and A.next_in_queue(q).first().id == 12
    v = spark.createDataFrame([("h1", "keep", 1), ("h1", "split", 2), ("h2", "keep", 3)], "hash string, verdict string, t int")
    assert [(r.hash, r.verdict) for r in A.with_verdicts(spark.createDataFrame([("h1",), ("h9",)], "hash string"), v).orderBy("hash").collect()] == [("h1", "split"), ("h9", None)]
    assert {r.hash for r in A.keep_verdicts(v, v.where("false"), 1).collect()} == {"h2"}


def test_aliases_and_futile_searches(run):
    rows = [ev("search", 1, 0, 0, word="foo"), ev("read", 1, 7, 9), ev("read", 1, 5, 120_000), ev("search", 2, 0, 0, word="bar"), ev("read", 2, 6, 120_001), ev("search", 3, 0, 0, word="a"), ev("search", 3, 0, 9, word="b")]
    assert sorted(run(rows, A.learned_aliases)) == [("foo", 5, 120_000), ("foo", 7, 9)]  # every read in time teaches
    assert sorted(run(rows, A.futile_searches)) == [(2, "bar", 0, None), (3, "a", 0, None)]  # a read too late redeems nothing


def test_the_last_search_of_a_session_is_settled(spark, tmp_path):
    """Nobody comes back to the session: its search is told when the watermark has left it behind, once."""
    day = 86_400_000

    def at(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
        A.futile_searches(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.actor, r.word, r.t) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert at([ev("search", 1, 0, day, word="lost"), ev("search", 2, 0, day, word="found"), ev("read", 2, 5, day + 9)]) == []
    assert at([ev("search", 3, 0, 5 * day, word="new")]) == [(1, "lost", day)]
    assert at([ev("read", 9, 1, 6 * day)]) == [(1, "lost", day)]


def test_ids_are_cut_not_dropped(spark):
    rows = spark.createDataFrame([("read", 1, list(range(60))), ("read", 2, [1]), ("odd", 3, [1]), ("read", -1, [1])], "type string, t bigint, ids array<int>")
    assert sorted((r.t, len(r.ids)) for r in A.valid(rows).collect()) == [(1, 50), (2, 1)]


def test_repeat_stubs(run):
    rows = [ev("read", 1, 5, t, word=h) for t, h in ((1, "x"), (2, "x"), (3, "x"), (4, "y"))]
    got = run(rows, lambda s: A.repeat_stubs(s.select(F.col("actor").alias("session"), "id", "t", F.col("word").alias("hash"))))
    assert [r[3] for r in sorted(got)] == [False, True, False, False]


def test_a_session_keeps_its_notes_and_forgets_old_ones():
    from collections import namedtuple

    R = namedtuple("R", "id hash t")
    none = float("nan")
    out, state = A._stub((7,), [R(1, "a", 10), R(2, "a", 11), R(1, "a", 12), R(none, "b", 13), R(1, "a", 14), R(2, "c", 15), R(none, "b", 16)], 0, [], [], [], [])
    assert out == [(7, 1, 10, False), (7, 2, 11, False), (7, 1, 12, True), (7, None, 13, False), (7, 1, 14, False), (7, 2, 15, False), (7, None, 16, True)]
    assert state[0] == [1, 2, None] and state[3] == [14 + A.KEEP_MS, 15 + A.KEEP_MS, 16 + A.KEEP_MS]
    later, left = A._stub((7,), [R(1, "a", 20), R(2, "c", 21)], 15 + A.KEEP_MS, *state)
    assert [x[3] for x in later] == [False, True] and left[0] == [2, None, 1]
