"""Streams of activity: validated events to daily counters, session state, learned aliases, queues and caches.

Input: type, actor, id, t (ms), ts (timestamp), source. State lives under a key of its own (an actor, a note or a
session). Within a batch a key's events are taken in order of time; a key whose last event the watermark has left
KEEP_MS behind is forgotten. What waits for time to pass (open windows, idle notes) waits for the watermark of `ts`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TYPES = ("search", "read", "write")
WINDOW_MS, PER_WINDOW = 1000, 30
DEDUP_MS, LEARN_MS, IDLE_MS = 15_000, 120_000, 1_800_000
RING, MOST_IDS, PER_SWEEP, VERDICTS = 10, 50, 10, 5000
KEEP_MS, LATE = 86_400_000, "1 day"


def valid(events: DataFrame) -> DataFrame:
    """Events of a known type with a time; of the notes that they name, the first MOST_IDS."""
    good = events.where(F.col("type").isin(*TYPES) & F.col("t").isNotNull() & (F.col("t") >= 0))
    return good.withColumn("ids", F.slice("ids", 1, MOST_IDS)) if "ids" in events.columns else good


def daily_counters(events: DataFrame, late: str = "1 day") -> DataFrame:
    """day, id, search, read, write; final once the watermark has passed the day."""
    w = F.window("ts", "1 day")
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), "id").agg(*[F.count_if(F.col("type") == t).alias(t) for t in TYPES])
    return g.select(F.to_date(F.col("w.start")).alias("day"), "id", *TYPES)


def once_per_session(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event under each key while the watermark remembers it: warnings given once."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def _stateful(events: DataFrame, keys: list[str], step: Callable, out: str, state: str, start: tuple, last: Callable | None = None, forgets: bool = False) -> DataFrame:
    """`step(key, rows, state values)`, with the watermark before the state values if it `forgets` by itself, takes a key's rows of a batch in order of time and gives output rows and the
    new state values; the state goes when the watermark is KEEP_MS past the last row, and `last(key, state values)`
    gives the rows that settle what it still held."""
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState):
        if held.hasTimedOut:
            if last is not None:
                yield pd.DataFrame(last(key, *held.get), columns=names)
            held.remove()
            return
        rows = pd.concat(list(frames), ignore_index=True).sort_values("t", kind="stable")
        now = (held.getCurrentWatermarkMs(),) if forgets else ()
        found, values = step(key, rows.itertuples(), *now, *(held.get if held.exists else start))
        held.update(values)
        held.setTimeoutTimestamp(max(int(rows["t"].max()), held.getCurrentWatermarkMs()) + KEEP_MS)
        yield pd.DataFrame(found, columns=names)

    timed = events.withColumn("_ts", F.timestamp_millis(F.col("t") + 1)).withWatermark("_ts", LATE)  # watermarks begin at 0
    return timed.groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _limit(key, rows, anchor, n):
    out = []
    for r in rows:
        if r.t - anchor >= WINDOW_MS:
            anchor, n = r.t, 0
        n += 1
        if n <= PER_WINDOW:
            out.append((r.source, r.id, r.type, r.t))
    return out, (int(anchor), int(n))


def rate_limit(events: DataFrame, per: str | None = None) -> DataFrame:
    """At most PER_WINDOW events in a second that begins with the first event after the last one ended: of all
    events, or `per` a column's value. The one window of all events is one key and so one task's work."""
    out, state = "source string, id bigint, type string, t bigint", "anchor bigint, n int"
    return _stateful(events.withColumn("_scope", F.col(per) if per else F.lit("all")), ["_scope"], _limit, out, state, (-WINDOW_MS, 0))


def _dedup(key, rows, reported, on_disk):
    out, reported, on_disk = [], list(reported), list(on_disk)
    for r in rows:
        near = lambda times: [x for x in times if abs(r.t - x) <= DEDUP_MS]  # noqa: B023, E731
        reported, on_disk = near(reported), near(on_disk)
        own, other = (reported, on_disk) if r.source == "reported" else (on_disk, reported)
        if other:  # the same write, seen the other way and counted then
            other.pop(0)
            continue
        own[:] = [int(r.t)]
        out.append((key[0], r.source, r.t))
    return out, (reported, on_disk)


def dedup_writes(events: DataFrame) -> DataFrame:
    """Writes counted once where a report and a change on disk within DEDUP_MS, in either order, are one write."""
    writes = events.where("type = 'write'")
    return _stateful(writes, ["id"], _dedup, "id bigint, source string, t bigint", "reported array<bigint>, on_disk array<bigint>", ([], []))


def _ids(x) -> list[int]:
    return [] if x is None else [int(i) for i in x if i is not None]


def learned_aliases(events: DataFrame, within: int = LEARN_MS) -> DataFrame:
    """word, note, t: each read of the actor `within` so many ms of its latest search teaches the search's word that
    note, unless the note was among the search's own `results` (array, if the events have it)."""
    def learn(key, rows, word, at, shown):
        out = []
        for r in rows:
            if r.type == "search":
                word, at, shown = r.word, int(r.t), _ids(getattr(r, "results", None))
            elif r.type == "read" and word is not None and 0 <= r.t - at <= within and r.id not in shown:
                out.append((word, r.id, int(r.t)))
        return out, (word, at, list(shown))

    return _stateful(events, ["actor"], learn, "word string, note bigint, t bigint", "word string, at bigint, shown array<bigint>", (None, 0, []))


def inject_aliases(searches: DataFrame, aliases: DataFrame) -> DataFrame:
    """Searches with the note that their word was learned for; `aliases` (word, note, count) is a table."""
    best = aliases.groupBy("word").agg(F.max_by("note", F.struct("count", -F.col("note"))).alias("alias"))
    return searches.where("type = 'search'").join(best, "word", "left")


def _stub(key, rows, now, ids, lasts, stubs, until):
    """Of each note the hash and whether it was a stub, until the watermark has left its last read KEEP_MS behind."""
    out, known = [], {i: x for i, *x in zip(ids, lasts, stubs, until) if x[2] >= now}
    for r in rows:
        note = None if pd.isna(r.id) else int(r.id)
        last, stubbed, _ = known.get(note, ("", False, 0))
        same = bool(r.hash == last and not stubbed)
        out.append((key[0], note, int(r.t), same))
        known[note] = (r.hash, same, max(int(r.t), now) + KEEP_MS)
    return out, (list(known), *map(list, zip(*known.values())))


def repeat_stubs(reads: DataFrame) -> DataFrame:
    """session, id, t, stub for reads with a content hash: a re-read of unchanged content is a stub, the next one
    is in full again. The state of a session holds its notes, as most of them are read once or twice."""
    out, state = "session bigint, id bigint, t bigint, stub boolean", "ids array<bigint>, lasts array<string>, stubs array<boolean>, until array<bigint>"
    return _stateful(reads, ["session"], _stub, out, state, ([], [], [], []), forgets=True)


def _outline(key, rows, shortened):
    out = []
    for r in rows:
        kind = "section" if r.section else "full" if shortened or r.tokens <= r.least else "outline"
        shortened = kind == "outline" or shortened and kind == "section"
        out.append((key[0], key[1], r.t, kind))
    return out, (bool(shortened),)


def outlines_first(reads: DataFrame, least: int) -> DataFrame:
    """session, id, t, shown: of a note of more than `least` tokens the outline first, a section where one is asked
    for, and the whole note when it is read again. Reads have session, id, t, tokens, section."""
    return _stateful(reads.withColumn("least", F.lit(least)), ["session", "id"], _outline, "session bigint, id bigint, t bigint, shown string", "shortened boolean", (False,))


def futile_searches(events: DataFrame, within: int = LEARN_MS) -> DataFrame:
    """actor, word, t, fingerprint: searches that led to no read `within` so many ms, with the state of the notes then
    (`fingerprint`, if the events have it). A search is settled by the actor's next search or read, or when the session
    is forgotten, so that the last one of a session comes out too."""
    def settle(key, rows, pending, at, mark):
        out = []
        for r in rows:
            if r.type not in ("search", "read"):
                continue
            redeemed = r.type == "read" and pending is not None and 0 <= r.t - at <= within
            if pending is not None and not redeemed:
                out.append((key[0], pending, at, mark))
            pending, at, mark = (r.word, int(r.t), getattr(r, "fingerprint", None)) if r.type == "search" else (None, 0, None)
        return out, (pending, at, mark)

    def last(key, pending, at, mark):
        return [] if pending is None else [(key[0], pending, at, mark)]

    return _stateful(events, ["actor"], settle, "actor bigint, word string, t bigint, fingerprint string", "word string, at bigint, mark string", (None, 0, None), last)


def known_futile(searches: DataFrame, futile: DataFrame, fingerprint: str) -> DataFrame:
    """Searches for words that found nothing while the notes were as they are now; any change makes them forgotten."""
    return searches.join(futile.where(F.col("fingerprint") == fingerprint).select("word").distinct(), "word", "left_semi")


def _ring(key, rows, ids, times):
    recent = list(zip(ids, times)) + [(int(r.id), int(r.t)) for r in rows]
    recent = sorted(recent, key=lambda x: x[1])[-RING:]  # late events take the place of their time
    return [(key[0], [i for i, _ in recent])], ([i for i, _ in recent], [t for _, t in recent])


def recent_ring(events: DataFrame, key: str) -> DataFrame:
    """By key and batch, the RING latest notes in order of time."""
    return _stateful(events, [key], _ring, f"{key} {events.schema[key].dataType.simpleString()}, ids array<bigint>", "ids array<bigint>, times array<bigint>", ([], []))


def _waiting(events: DataFrame, keys: list[str], step: Callable, due: Callable, out: str, state: str, start: tuple, late: str) -> DataFrame:
    """Like _stateful, but with output when the watermark passes a time: `step` gives the new state values,
    `due(key, values, watermark ms)` output rows, the values left and the time to wait for, if any."""
    names = [c.strip().split(" ")[0] for c in out.split(",")]

    def run(key, frames: Iterator[pd.DataFrame], held: GroupState):
        values = held.get if held.exists else start
        if not held.hasTimedOut:
            rows = pd.concat(list(frames), ignore_index=True).sort_values("t", kind="stable")
            values = step(rows.itertuples(), *values)
        now = held.getCurrentWatermarkMs()
        found, values, then = due(key, values, now)
        if then is None:
            held.remove()
        else:
            held.update(values)
            held.setTimeoutTimestamp(max(then, now + 1))
        yield pd.DataFrame(found, columns=names)

    return events.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(run, out, state, "append", GroupStateTimeout.EventTimeTimeout)


def _episode_step(rows, searches, reads):
    searches, reads = list(searches), list(reads)
    for r in rows:
        (searches if r.type == "search" else reads).append(int(r.t))
    return searches, reads


def _episode_due(look_ahead: int):
    def due(key, values, now):
        searches, reads = sorted(values[0]), sorted(values[1])
        out, still = [], []
        for s in searches:
            if now <= s + look_ahead:
                still.append(s)
                continue
            hit = next((r for r in reads if s <= r <= s + look_ahead), None)
            out.append((key[0], s, hit, None if hit is None else hit - s))
        oldest = min(still, default=None)
        reads = [r for r in reads if oldest is not None and r >= oldest]
        return out, (still, reads), None if oldest is None else oldest + look_ahead + 1

    return due


def closed_episodes(events: DataFrame, look_ahead: int = LEARN_MS, late: str = "10 seconds") -> DataFrame:
    """actor, t, read_t, delay of searches, each once its look-ahead has passed for certain; events that come late,
    but within `late`, count at their time."""
    both = events.where(F.col("type").isin("search", "read"))
    out = "actor bigint, t bigint, read_t bigint, delay bigint"
    return _waiting(both, ["actor"], _episode_step, _episode_due(look_ahead), out, "searches array<bigint>, reads array<bigint>", ([], []), late)


def idle_notes(writes: DataFrame, idle_ms: int = IDLE_MS, late: str = "10 seconds") -> DataFrame:
    """id, last_t, due_t of notes that were written and then left alone for `idle_ms`: candidates for a split."""
    def step(rows, last):
        return (max(last, *(int(r.t) for r in rows)),)

    def due(key, values, now):
        at = values[0] + idle_ms
        return ([(key[0], values[0], at)], values, None) if now > at else ([], values, at + 1)

    return _waiting(writes.where("type = 'write'"), ["id"], step, due, "id bigint, last_t bigint, due_t bigint", "last bigint", (0,), late)


def sweep(candidates: DataFrame, queued: DataFrame, most: int = PER_SWEEP) -> DataFrame:
    """What a sweep adds to the queue: up to `most` candidates that are not in it, those due first before others."""
    return candidates.join(queued.select("id"), "id", "left_anti").orderBy("due_t", "id").limit(most)


def next_in_queue(queued: DataFrame) -> DataFrame:
    """The one to work on: queued first."""
    return queued.orderBy("queued_t", "id").limit(1)


def with_verdicts(items: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Items with the verdict that was given for their content (hash), if one was: verdicts do not age."""
    known = verdicts.groupBy("hash").agg(F.max_by("verdict", "t").alias("verdict"))
    return items.join(known, "hash", "left")


def keep_verdicts(old: DataFrame, new: DataFrame, most: int = VERDICTS) -> DataFrame:
    """The newest `most` verdicts, one for each content."""
    each = old.unionByName(new).groupBy("hash").agg(F.max_by("verdict", "t").alias("verdict"), F.max("t").alias("t"))
    return each.orderBy(F.desc("t"), "hash").limit(most)


def upsert_each(stream: DataFrame, merge: Callable[[DataFrame, DataFrame | None], DataFrame], path: str, checkpoint: str):
    """Start a query that merges each batch into the table at `path`, a new version at a time: the last version is
    read, `merge(batch, old)` written beside it. Batches that come again write the same version again."""
    def one(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        old = spark.read.parquet(f"{path}/v{n - 1}") if n else None
        merge(batch, old).write.mode("overwrite").parquet(f"{path}/v{n}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_available(stream: DataFrame, path: str) -> DataFrame:
    """All that a stream holds now, through a file sink in the folder `path`."""
    q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
