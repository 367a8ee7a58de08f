"""Vectors kept in step with a stream of changed notes: what is new is embedded once, what is unchanged or gone is not.

Chunks lie in buckets by note. A batch reads and writes the buckets of its own notes alone, in a folder of the batch; a
manifest, one row a bucket, says in which batch's folder each bucket stands. A batch that comes again after a failure
starts from the manifest before it and writes the same folder. Many changes of one note in a batch are one: the last by
`t`, of equal times the greatest text. If the embedder fails, so does the batch, and the next start takes it up again.

Notes: permalink, title, description, text, removed (boolean), t. A null permalink is left out; a null or empty text has
no chunks; a chunk for which the embedder gives no vector isn't stored, and asked for again when its note comes again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvex.operators import graph as G
from corvex.operators import lifecycle as L
from corvex.operators import semantic as V

BUCKETS, MOST_BUCKETS, FILES = 64, 1 << 16, 4
STORED = "key string, permalink string, heading string, hash string, vector array<double>, bucket int"
MANIFEST = "bucket int, batch bigint"


def chunks(notes: DataFrame) -> DataFrame:
    """The chunks of notes (permalink, title, description, text) by section."""
    spans = L.section_spans(notes.select(F.col("permalink").alias("id"), F.coalesce("text", F.lit("")).alias("body")))
    own = notes.select("permalink", F.col("title").alias("name"), "description")
    each = spans.select(F.col("id").alias("permalink"), "pos", F.col("title").alias("heading"), "text").join(own, "permalink")
    return V.chunks_of(each.withColumnRenamed("name", "title"))


def manifest(spark: SparkSession, path: str, batch: int) -> dict[int, int]:
    """Bucket to batch, as it was after a batch: at most one entry a bucket."""
    if batch < 0:
        return {}
    return {r.bucket: r.batch for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest/v{batch}").collect()}


def _rows(spark: SparkSession, path: str, where: dict[int, int]) -> DataFrame:
    if not where:
        return spark.createDataFrame([], STORED)
    folders = [f"{path}/data/batch={n}/bucket={b}" for b, n in sorted(where.items())]
    return spark.read.schema(STORED + ", batch bigint").option("basePath", f"{path}/data").parquet(*folders).select(*STORED.replace(",", "").split()[::2])


def stored(spark: SparkSession, path: str, batch: int) -> DataFrame:
    """key, permalink, heading, hash, vector, bucket after a batch."""
    return _rows(spark, path, manifest(spark, path, batch))


def apply_batch(notes: DataFrame, n: int, path: str, embedder: Callable[[list[str]], list[list[float]]], buckets: int = BUCKETS, files: int = FILES) -> None:
    """Bring the vectors at `path` from the state after batch n - 1 to that after this one."""
    if not 1 <= buckets <= MOST_BUCKETS:
        raise ValueError(f"buckets are 1 to {MOST_BUCKETS}")
    spark, c = notes.sparkSession, F.col
    bucket = F.pmod(F.xxhash64("permalink"), F.lit(buckets)).cast("int").alias("bucket")
    last = F.max(F.struct("t", "text", "title", "description", "removed")).alias("x")
    latest = G.cut(notes.where("permalink IS NOT NULL").groupBy("permalink").agg(last).select("permalink", "x.*", bucket))
    before = manifest(spark, path, n - 1)
    touched = {r.bucket for r in latest.select("bucket").distinct().collect()}  # at most `buckets`
    old = _rows(spark, path, {b: before[b] for b in touched if b in before})
    wanted = G.cut(chunks(latest.where(~F.coalesce("removed", F.lit(False)))))
    others = old.join(latest.select("permalink"), "permalink", "left_anti")
    kept = wanted.select("key", "permalink", "heading", "hash").join(old.select("key", "hash", "vector"), ["key", "hash"])
    fresh = V.embed(V.missing(wanted, old), embedder).where(F.size("vector") > 0).withColumn("vector", V.normalize(c("vector")))
    cols = ["key", "permalink", "heading", "hash", "vector"]
    out = others.select(*cols).unionByName(kept.select(*cols)).unionByName(fresh.select(*cols)).withColumn("bucket", bucket)
    folder = f"{path}/data/batch={n}"
    out.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(files))).write.mode("overwrite").partitionBy("bucket").parquet(folder)
    have = {r.bucket for r in spark.read.schema(STORED).parquet(folder).select("bucket").distinct().collect()} if touched else set()
    now = {b: k for b, k in before.items() if b not in touched} | {b: n for b in have}
    spark.createDataFrame(sorted(now.items()), MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v{n}")


def follow(changes: DataFrame, path: str, checkpoint: str, embedder: Callable[[list[str]], list[list[float]]], buckets: int = BUCKETS, files: int = FILES, **trigger):
    """Start the query that keeps the vectors at `path`, by default with all that is there now. Path and checkpoint belong
    together: a new checkpoint needs a new path, and so does another number of buckets."""
    def one(batch: DataFrame, n: int) -> None:
        apply_batch(batch, n, path, embedder, buckets, files)

    return changes.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
