"""Scans over one order of all rows without a window that puts them in one task.

Rows are dealt into stretches of the order by bounds taken from quantiles. Each stretch is scanned by itself, a summary
of a row each is carried over the stretches (at most PARTS of them), and what a stretch was handed completes its rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARTS = 512
BLOCKS = 1 << 40  # run names of a stretch
SMALL = 20_000  # rows of a stretch, at least, as far as they go


def stretches(df: DataFrame, by: str, parts: int | None = None) -> DataFrame:
    """`df` plus _part, a number that rises with the numeric column `by`; equal values share one. One pass counts the
    rows and finds the bounds."""
    n = df.count() if parts is None else 0
    wanted = parts or max(1, min(PARTS, n // SMALL))
    bounds = [] if wanted == 1 else df.select(F.percentile_approx(by, [k / wanted for k in range(1, wanted)], 10_000).alias("q")).first()["q"] or []
    above = F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(by))) if bounds else F.lit(0)
    return df.withColumn("_part", above)


def numbered(df: DataFrame, by: str, then: list[str], name: str = "pos", parts: int | None = None) -> DataFrame:
    """`df` plus `name`: positions from 0 in the order of `by`, then the columns of `then`."""
    s = stretches(df, by, parts)
    sizes = {r["_part"]: r["count"] for r in s.groupBy("_part").count().collect()}  # a row a stretch
    before, total = {}, 0
    for p in sorted(sizes):
        before[p], total = total, total + sizes[p]
    shift = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), F.col("_part")) if before else F.lit(0)
    at = F.row_number().over(W.partitionBy("_part").orderBy(by, *then)) - 1
    return s.withColumn(name, (shift + at).cast("bigint")).drop("_part")


def runs(df: DataFrame, by: str, then: list[str], same: list[str], gap: int, counts: str, parts: int | None = None) -> DataFrame:
    """`df` plus run, run_pos: rows for which `counts` (a boolean column) holds, one after the other in the whole order,
    equal in `same` and at most `gap` of `by` apart, are a run, named by the place of its first row; other rows have
    none."""
    s = stretches(df, by, parts)
    w = W.partitionBy("_part").orderBy(by, *then)
    apart = reduce(or_, [~F.lag(c).over(w).eqNullSafe(F.col(c)) for c in same], F.lit(False))
    broken = ~F.lag(counts).over(w) | apart | (F.col(by) - F.lag(by).over(w) > gap)
    s = s.withColumn("_n", F.row_number().over(w)).withColumn("_new", ~F.col(counts) | (F.col("_n") > 1) & broken)
    s = s.withColumn("_block", F.sum(F.col("_new").cast("bigint")).over(w))  # 0: what may go on from before
    size = s.groupBy("_part", "_block").agg(F.count("*").alias("k"))
    key = F.struct(by, *same, counts)
    ends = s.groupBy("_part").agg(F.min_by(key, "_n").alias("first"), F.max_by(key, "_n").alias("last"), F.max("_block").alias("_block"))
    told = ends.join(size, ["_part", "_block"]).orderBy("_part").collect()  # a row a stretch
    handed, before, held, name = {}, None, 0, None
    for r in told:  # what the run at the end of all earlier stretches hands on
        first, last = r["first"], r["last"]
        goes_on = before is not None and first[counts] and before[counts] and all(first[c] == before[c] for c in same) and first[by] - before[by] <= gap
        if goes_on:
            handed[r["_part"]] = (name, held)
        if goes_on and r["_block"] == 0:  # from end to end
            held += r["k"]
        else:
            held, name = r["k"], r["_part"] * BLOCKS + r["_block"]
        before = last
    given = F.create_map(*[F.lit(x) if isinstance(x, int) else x for p, (r, h) in handed.items() for x in (p, F.struct(F.lit(r).cast("bigint").alias("r"), F.lit(h).cast("bigint").alias("h")))]) if handed else None
    got = F.when(F.col("_block") == 0, F.try_element_at(given, F.col("_part"))) if handed else F.lit(None).cast("struct<r:bigint,h:bigint>")
    s = s.withColumn("_got", got).withColumn("_at", F.row_number().over(W.partitionBy("_part", "_block").orderBy("_n")) - 1)
    run = F.coalesce("_got.r", F.col("_part").cast("bigint") * BLOCKS + F.col("_block"))
    pos = (F.col("_at") + F.coalesce("_got.h", F.lit(0))).cast("bigint")
    return s.withColumn("run", F.when(F.col(counts), run)).withColumn("run_pos", F.when(F.col(counts), pos)).drop("_part", "_new", "_n", "_block", "_got", "_at")
