"""SimHash near-duplicates by pigeonhole blocks.

A document's fingerprint is the bitwise majority of the XXH64 values of its word shingles. Two fingerprints
that differ in at most DISTANCE of 64 bits agree on all but DISTANCE of m blocks; so, for each choice of
m - DISTANCE blocks, fingerprints that agree on them meet in a bucket, where the distance is verified.

Fingerprints are made distinct first, so exact copies cost nothing. A bucket of more than BUCKET
fingerprints moves to the next, finer family of FAMILIES, which finds the same pairs in smaller buckets;
a bucket of the last family fixes 52 bits and holds at most 4,096. From a bucket come not all its pairs but
a spanning forest of them, which keeps every component. Components are found by star contraction over
tables, with a checkpoint each round.

Defined results: null and empty texts have fingerprint 0 and link like any other; rows with a null id get
their component from the others and never name it, unless all are null; repeated rows come out as often as
they went in; an empty table gives an empty table.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_column

SHINGLE = 3
SEED = 42
DISTANCE = 3
FAMILIES = (4, 7, 16)  # numbers of blocks
BUCKET = 512
HOT_KEYS = 1000


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII capitals and spaces only
    if not w:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= size:
        return np.array([h(b" ".join(w), seed)], np.uint64)
    line, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    starts = (ends[: 1 - size] - np.fromiter(map(len, w[: 1 - size] if size > 1 else w), np.int64) - 1).tolist()
    stops = (ends[size - 1 :] - 1).tolist()
    return np.fromiter([h(line[a:b], seed) for a, b in zip(starts, stops)], np.uint64, len(stops))


def fingerprint(text: str | None) -> int:
    h = shingle_hashes(text)
    if not len(h):
        return 0
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    top = bits.sum(axis=0, dtype=np.int64) * 2 > len(h)
    return int(np.packbits(top).view(np.int64)[0])  # signed, as a Spark bigint


def fingerprints(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """`carry` plus fp bigint."""
    cols = docs.columns if carry is None else carry
    return map_column(docs, [text_col], cols, [("fp", "bigint")], lambda: lambda ts: [(fingerprint(t),) for t in ts])


def masks(blocks: int, distance: int = DISTANCE) -> list[int]:
    """For each choice of blocks - distance blocks of 64 bits, the mask of their bits, as signed bigint."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    block = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    chosen = (sum(c) for c in itertools.combinations(block, blocks - distance))
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Edges (member, smallest member) of the components of one bucket, over distinct fingerprints."""
    n = len(fps)
    fps = np.sort(fps)
    u = fps.view(np.uint64)
    label = np.arange(n)
    near = []
    step = max(1, (1 << 20) // n)
    for a in range(0, n, step):
        i, j = np.nonzero(np.bitwise_count(u[a : a + step, None] ^ u[None, :]) <= distance)
        keep = i + a < j
        near.append(np.stack([i[keep] + a, j[keep]]))
    i, j = np.concatenate(near, axis=1)
    while True:
        old = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == old).all():
            break
    return [(int(fps[k]), int(fps[label[k]])) for k in np.flatnonzero(label != np.arange(n))]


def _bucket_edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Input is sorted by key; a bucket may go on in the next batch."""
    rest = None
    for b in batches:
        if rest is not None and len(rest):
            b = pd.concat([rest, b], ignore_index=True)
        t, k = b["t"].to_numpy(), b["k"].to_numpy()
        if not len(t):
            continue
        new = np.flatnonzero((t[1:] != t[:-1]) | (k[1:] != k[:-1])) + 1
        cut = int(new[-1]) if len(new) else 0
        rest = b.iloc[cut:]
        if cut:
            yield _edges(b["fp"].to_numpy()[:cut], np.concatenate([[0], new]))
    if rest is not None and len(rest):
        yield _edges(rest["fp"].to_numpy(), np.array([0, len(rest)]))


def _edges(fp: np.ndarray, bounds: np.ndarray) -> pd.DataFrame:
    """bounds: starts of buckets and the end of the last."""
    sizes, out = np.diff(bounds), []
    pair = bounds[:-1][sizes == 2]
    if len(pair):  # most buckets that hold more than one hold two
        a, b = fp[pair], fp[pair + 1]
        ok = np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= DISTANCE
        out.append(np.stack([np.maximum(a, b)[ok], np.minimum(a, b)[ok]], axis=1))
    for k in np.flatnonzero(sizes > 2):
        e = forest(fp[bounds[k] : bounds[k + 1]])
        if e:
            out.append(np.array(e, np.int64))
    e = np.concatenate(out) if out else np.zeros((0, 2), np.int64)
    return pd.DataFrame({"a": e[:, 0], "b": e[:, 1]})


def links(distinct: DataFrame) -> DataFrame:
    """Edges (a, b) between near fingerprints, from one column fp of distinct fingerprints."""
    todo, edges = distinct.select("fp"), None
    for i, blocks in enumerate(FAMILIES):
        literal = F.expr(f"array({', '.join(f'{m}L' for m in masks(blocks))})")
        rows = todo.select("fp", F.posexplode(literal).alias("t", "m")).select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("k"))
        sizes = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
        last = i == len(FAMILIES) - 1
        fit = sizes if last else sizes.where(F.col("n") <= BUCKET)
        near = (
            rows.join(fit.select("t", "k"), ["t", "k"], "left_semi")
            .repartition("t", "k").sortWithinPartitions("t", "k").select("t", "k", "fp")
            .mapInPandas(_bucket_edges, "a bigint, b bigint")
        )
        edges = near if edges is None else edges.unionByName(near)
        if not last:
            over = sizes.where(F.col("n") > BUCKET).select("t", "k")
            todo = checkpoint(rows.join(over, ["t", "k"], "left_semi").select("fp").distinct())
            if not todo.limit(1).count():
                break
    return edges.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for nodes with an edge; by alternating star contraction."""

    def settle(e):
        e = checkpoint(e.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        return e, tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    def low(pairs):
        return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    e, sign = settle(edges)
    while sign[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = both.join(low(both), "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        big = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        m = low(big)
        small = big.join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(m.select(F.col("u").alias("a"), F.col("m").alias("b")))
        e, new = settle(small)
        if new == sign:
            break
        sign = new
    return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _join_one(big: DataFrame, one: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """`big` with the row of `one` under its key; `n` tells how many of the `total` rows of `big` have it. Keys with
    more than one row in HOT_KEYS, of which there are fewer than that, are broadcast, so none fills a task alone."""
    hot = one.where(F.col(n) * HOT_KEYS > total).drop(n)
    cold = big.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.drop(n), key)
    return cold.unionByName(big.join(F.broadcast(hot), key))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row for each row of `docs`: doc_id, fp, root (a fingerprint that names the group) and component_id."""
    view = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    prints = checkpoint(fingerprints(view, "text", ["doc_id"]))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    roots = components(links(nodes))
    labelled = checkpoint(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root")))
    named = labelled.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m"))
    rows, distinct = labelled.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tagged = _join_one(labelled.select("fp", "n", "root"), named, "root", "m", distinct)
    return _join_one(prints, tagged, "fp", "n", rows).select("doc_id", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `docs`: doc_id, fp bigint, component_id."""
    return _groups(docs, id_col, text_col).drop("root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each near-duplicate group: that of the smallest id, of several such rows the one
    of the smallest text. Rows with a null id stay."""
    found, ident = _groups(docs, id_col, text_col), F.col(f"`{id_col}`").cast("bigint")
    first = F.col("doc_id") == F.col("component_id")
    keep = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or(first).alias("first")).where("first")
    keep = checkpoint(keep.select(F.col("doc_id").alias("_cx_keep"), "n"))
    several = keep.where("n > 1")
    if not several.limit(1).count():
        own = docs.join(keep, ident == F.col("_cx_keep"), "left_semi")
    else:  # the id alone does not tell which of its rows is the group's
        own = docs.join(keep.where("n = 1"), ident == F.col("_cx_keep"), "left_semi")
        rows = docs.join(several, ident == F.col("_cx_keep"), "left_semi")
        rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_cx_row"), ident.alias("_cx_id"), F.col(f"`{text_col}`").alias("_cx_text"))
        roots = found.where(first).select(F.col("doc_id").alias("_cx_id"), "fp", "root").distinct()
        rows = fingerprints(rows, "_cx_text", rows.columns).join(roots, ["_cx_id", "fp"])
        least = F.min_by("_cx_row", F.struct("_cx_text", F.to_json("_cx_row")))
        picked = rows.groupBy("_cx_id", "root").agg(least.alias("r"))
        own = own.unionByName(picked.select(*[F.col("r").getField(c).alias(c) for c in docs.columns]))
    return own.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
