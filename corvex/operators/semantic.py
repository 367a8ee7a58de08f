"""Vector and hybrid retrieval: chunks, unit vectors, cosine top-k, max-pooling, reciprocal rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvex.functions import text as X

TOP, RRF = 50, 60
CHUNK_CHARS, INPUT_CHARS = 1600, 3200


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_top(chunks: DataFrame, query: list[float], top: int = TOP) -> DataFrame:
    """key, permalink, score of the `top` chunks of largest cosine; the query is a literal."""
    q = normalize(F.array(*[F.lit(float(x)) for x in query]))
    scored = chunks.select("key", "permalink", dot(normalize(F.col("vector")), q).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(top)


def pool(hits: DataFrame) -> DataFrame:
    """The best chunk's score by note, and ranks from 1."""
    best = hits.groupBy("permalink").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "permalink")))  # at most TOP rows


def fuse(lexical: DataFrame, vector: DataFrame, k: int = RRF) -> DataFrame:
    """permalink, score from two rankings (permalink, rank): the sum of 1/(k + rank)."""
    both = lexical.select("permalink", F.col("rank").alias("r1")).join(vector.select("permalink", F.col("rank").alias("r2")), "permalink", "full")
    part = lambda r: F.coalesce(1 / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    return both.select("permalink", (part("r1") + part("r2")).alias("score"))


def split_paragraphs(body: Column, most: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed into pieces of at most `most` characters; of a longer one, so many characters at a time,
    the rest going on with what follows."""
    def pack(acc, p):
        last = F.element_at(acc, -1)
        joined = F.when(last == "", p).otherwise(F.concat(last, F.lit("\n\n"), p))
        over = (F.length(joined) > most) & (last != "")
        done = F.when(over, acc).otherwise(F.slice(acc, F.lit(1), F.size(acc) - 1))
        rest = F.when(over, p).otherwise(joined)
        cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(rest) / most) - 1, F.lit(0)).cast("int"))
        return F.concat(done, F.transform(cuts, lambda k: F.substring(rest, k * most + 1, F.lit(most))))

    packed = F.aggregate(F.split(body, r"\n{2,}"), F.array(F.lit("")), pack)
    trimmed = F.filter(F.transform(packed, lambda p: F.trim(p)), lambda p: p != "")
    return F.when(F.length(body) <= most, F.filter(F.array(F.trim(body)), lambda p: p != "")).otherwise(trimmed)


def chunks_of(sections: DataFrame) -> DataFrame:
    """From permalink, title, description, pos, heading, text: key, permalink, heading, text, embed_input, hash. What
    is embedded has the title, the description and a heading of another name before the text."""
    each = sections.select("permalink", "title", "description", "pos", "heading", F.posexplode(split_paragraphs(F.col("text"))).alias("part", "text"))
    some = F.filter(F.array("title", "description", F.when(F.col("heading") != F.col("title"), F.col("heading")), "text"), lambda x: x.isNotNull() & (x != ""))
    joined = F.substring(F.array_join(some, "\n\n"), 1, INPUT_CHARS)
    key = F.concat("permalink", F.lit("#"), F.col("pos"), F.lit("."), F.col("part"))
    return each.select(key.alias("key"), "permalink", "heading", "text", joined.alias("embed_input"), F.sha1(joined).alias("hash"))


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Chunks to embed: those not cached under the same hash."""
    return wanted.join(cached.select("key", "hash"), ["key", "hash"], "left_anti")


def prune(cached: DataFrame, wanted: DataFrame) -> DataFrame:
    return cached.join(wanted.select("key", "hash"), ["key", "hash"], "left_semi")


def embed(chunks: DataFrame, embedder: Callable[[list[str]], list[list[float]]], batch: int = 16) -> DataFrame:
    """`chunks` plus vector, by an injected embedder of batches of texts."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts, out = f["embed_input"].tolist(), []
            for a in range(0, len(texts), batch):
                out += embedder(texts[a : a + batch])
            yield f.assign(vector=out)

    from pyspark.sql import types as T

    return chunks.mapInPandas(run, T.StructType([*chunks.schema.fields, T.StructField("vector", T.ArrayType(T.FloatType()))]))


def semantic_search(chunks: DataFrame, query: list[float], allowed: DataFrame | None = None) -> DataFrame:
    """Ranked notes; filters apply to the top chunks, not before them."""
    hits = vector_top(chunks, query)
    if allowed is not None:
        hits = hits.join(allowed.select("permalink"), "permalink", "left_semi")
    return pool(hits)


def store(chunks: DataFrame, path: str, provider: str, model: str, dim: int) -> None:
    meta = {"provider": provider, "model": model, "dim": dim}
    chunks.withColumns({k: F.lit(v) for k, v in meta.items()}).write.mode("overwrite").parquet(path)


def load(spark, path: str, provider: str, model: str, dim: int) -> DataFrame:
    """Stored vectors; none if they were made by another provider or model or have another length."""
    same = (F.col("provider") == provider) & (F.col("model") == model) & (F.col("dim") == dim)
    return spark.read.parquet(path).where(same & (F.size("vector") == dim)).drop("provider", "model", "dim")
