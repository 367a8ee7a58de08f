"""Evaluation of searches and runs: ranks, paired bootstrap intervals, accuracy, token ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scan
from .graph import cut

RESAMPLES, SEED, LOW, HIGH = 2000, 7, 50, 1949
CALL_TOKENS = 5000
MASK = 0xFFFFFFFF


def retrieval(ranks: DataFrame) -> DataFrame:
    """One row from rank (0: not found): n, mrr, in_results, first, top3."""
    r = F.col("rank")
    return ranks.agg(
        F.count("*").alias("n"), F.round(F.avg(F.when(r > 0, 1 / r).otherwise(0.0)), 6).alias("mrr"), F.count_if(r > 0).alias("in_results"),
        F.count_if(r == 1).alias("first"), F.count_if((r > 0) & (r <= 3)).alias("top3"),
    )


def mulberry32(seed: int, n: int) -> list[float]:
    """n numbers in [0, 1) of the 32-bit generator of that name."""
    out, a, mask = [], seed & 0xFFFFFFFF, 0xFFFFFFFF
    for _ in range(n):
        a = (a + 0x6D2B79F5) & mask
        t = ((a ^ (a >> 15)) * (a | 1)) & mask
        t = (((t + (((t ^ (t >> 7)) * (t | 61)) & mask)) & mask) ^ t) & mask
        out.append(((t ^ (t >> 14)) & mask) / 4294967296)
    return out


def _times(x: Column, y: Column) -> Column:
    """The low 32 bits of the product of two numbers of 32 bits."""
    high = F.shiftrightunsigned(y, 16)
    return (x * y.bitwiseAND(F.lit(0xFFFF)) + F.shiftleft((x * high).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(MASK))


def draw(i: Column, seed: int) -> Column:
    """Number i, from 0, of `mulberry32(seed)`: its state is a counter, so no draw needs those before it."""
    a = (F.lit(seed & MASK) + _times(F.lit(0x6D2B79F5).cast("bigint"), (i + 1).cast("bigint").bitwiseAND(F.lit(MASK)))).bitwiseAND(F.lit(MASK))
    t = _times(a.bitwiseXOR(F.shiftrightunsigned(a, 15)), a.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(MASK)))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / F.lit(4294967296.0)


def relative_difference(runs: DataFrame, variant: str, base: str) -> DataFrame:
    """One row: the relative change of the mean over questions that both variants answered, and its
    bootstrap interval from order statistics LOW and HIGH of RESAMPLES. `runs`: question, variant, value.
    Resample r draws numbers r n to r n + n - 1 of the generator, each a row, so any number of questions is dealt over
    all tasks; draws are counted before they are joined. Without such questions there is no row."""
    means = runs.where(F.col("variant").isin(variant, base)).groupBy("question").pivot("variant", [base, variant]).agg(F.avg("value"))
    paired = means.where(F.col(base).isNotNull() & F.col(variant).isNotNull()).select("question", F.col(base).alias("b"), F.col(variant).alias("v"))
    paired = cut(scan.numbered(paired, "question", []))
    n = paired.count()
    draws = runs.sparkSession.range(RESAMPLES * n).select(F.floor(F.col("id") / max(n, 1)).alias("r"), F.floor(draw(F.col("id"), SEED) * n).alias("pos"))
    often = draws.groupBy("r", "pos").count()
    sums = often.join(paired.select("pos", "b", "v"), "pos").groupBy("r").agg((F.sum(F.col("v") * F.col("count")) / F.sum(F.col("b") * F.col("count")) - 1).alias("d"))
    order = sums.agg(F.array_sort(F.collect_list("d")).alias("d"))  # RESAMPLES numbers
    whole = paired.agg(F.count("*").alias("n"), (F.sum("v") / F.sum("b") - 1).alias("change")).where("n > 0")
    return whole.crossJoin(F.broadcast(order)).select("n", "change", F.get("d", F.lit(LOW)).alias("low"), F.get("d", F.lit(HIGH)).alias("high"))  # one row each


def accuracy(runs: DataFrame) -> DataFrame:
    return runs.groupBy("variant", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("correct")).alias("correct"))


def spread(runs: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, median and sample deviation (0 for one) by group."""
    return runs.groupBy(by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.median(value), 6).alias("median"),
        F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("deviation"),
    )


def token_ratio(texts: DataFrame, buckets: tuple[int, ...] = (200, 1000, 4000)) -> DataFrame:
    """From estimate and actual: by size bucket, n, the mean ratio and the gap of the sums."""
    a = F.col("actual")
    size = F.lit(len(buckets))
    for i in reversed(range(len(buckets))):
        size = F.when(a <= buckets[i], i).otherwise(size)
    good = texts.where(a > 0)
    return good.groupBy(size.cast("int").alias("bucket")).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("estimate") / a), 6).alias("ratio"), (F.sum("estimate") - F.sum("actual")).alias("gap"))


def effective_tokens(replays: DataFrame, off: str = "off") -> DataFrame:
    """variant, calls, tokens, effective (tokens and CALL_TOKENS a call) and what it saves against `off`."""
    g = replays.groupBy("variant").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    e = g.withColumn("effective", F.col("tokens") + CALL_TOKENS * F.col("calls"))
    base = F.broadcast(e.where(F.col("variant") == off).select(F.col("effective").alias("base")))  # one row
    return e.join(base).select("variant", "calls", "tokens", "effective", (F.col("base") - F.col("effective")).alias("saved"))
