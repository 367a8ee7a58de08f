"""How many words rows have in common, for all pairs of rows with one key.

Rows are dealt into blocks by a hash of their id, and a pair of blocks is one group: it holds both blocks' rows, counts
in numpy what they share, a strip of rows at a time, and hands on only what is asked for. Pairs are never shuffled; the
rows travel once for each block that they meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 16384  # rows in a block, about
CELLS = 1 << 20  # pairs counted at a time
HITS = 1 << 22  # common words counted at a time, but for one row's
SEPARATOR = "\x1f"


def joined(words: Column) -> Column:
    """Distinct words as one string, which travels better than an array; none for null."""
    return F.coalesce(F.array_join(F.array_distinct(words), SEPARATOR), F.lit(""))


def sized(rows: DataFrame, by: list[str], size: str) -> DataFrame:
    """The number of blocks of each key."""
    return rows.groupBy(*by).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(size))


def in_block(id: str, blocks: str) -> Column:
    return F.pmod(F.xxhash64(id), F.col(blocks)).cast("int")


def each_block(blocks: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))


def grouped(rows: DataFrame, by: list[str]):
    """Groups by `by`. The number of partitions is the session's even where they are small, as they take long."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by).groupBy(*by)


def _words(rows: pa.ChunkedArray) -> pa.ListArray:
    return pc.split_pattern(rows.combine_chunks() if isinstance(rows, pa.ChunkedArray) else rows, SEPARATOR)


def strips(left: pa.ChunkedArray, right: pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray]]:
    """For rows of `left`, a strip after another: the first's number, and how many words each has in common with each
    of `right`."""
    n, m = len(left), len(right)
    if not n or not m:
        return
    lists = pa.chunked_array([_words(left), _words(right)]).combine_chunks()
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    code, kinds = coded.indices.to_numpy(), len(coded.dictionary)
    owner = np.repeat(np.arange(n + m), pc.list_value_length(lists).to_numpy())
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    code, owner = code[real], owner[real]
    ours = owner < n
    theirs = np.argsort(code[~ours], kind="stable")
    has = (owner[~ours][theirs] - n).astype(np.int32)  # rows of right by word
    start = np.searchsorted(code[~ours][theirs], np.arange(kinds + 1))
    code, owner = code[ours], owner[ours]
    many = start[code + 1] - start[code]
    code, owner, many = code[many > 0], owner[many > 0], many[many > 0]
    until = np.cumsum(np.bincount(owner, many, n))  # common words up to a row
    most, at = max(CELLS // m, 1), 0
    while at < n:
        end = min(at + most, int(np.searchsorted(until, (until[at - 1] if at else 0) + HITS, side="right")), n)
        end = max(end, at + 1)
        x, y = np.searchsorted(owner, (at, end))
        k = many[x:y]
        before = np.cumsum(k) - k
        places = np.repeat((start[code[x:y]] - before).astype(np.int32), k) + np.arange(k.sum(), dtype=np.int32)
        cells = np.repeat(((owner[x:y] - at) * m).astype(np.int32), k) + has[places]
        yield at, np.bincount(cells, minlength=(end - at) * m).reshape(end - at, m)
        at = end


def best(left: DataFrame, right: DataFrame, by: list[str], most: int, order: list[tuple[str, str]], schema: str) -> DataFrame:
    """For each row of `left` (`by`, id, words, least) those `most` of `right` (`by`, other, words and the columns of
    `order`) with most words in common, `least` at the least; of equal ones the first by `order`. Columns: `by`, id,
    other, those of `order` and shared; `schema` has their types. Every block of `right` names its own `most`, from which
    the caller takes the first ones."""
    sizes = sized(left, by, "_n").join(sized(right, by, "_m"), by)
    named = [c for c, _ in order if c != "other"]
    a = left.join(sizes, by).select(*by, in_block("id", "_n").alias("_i"), each_block("_m").alias("_j"), "id", "words", "least")
    b = right.join(sizes, by).select(*by, in_block("other", "_m").alias("_j"), each_block("_n").alias("_i"), "other", "words", *named)
    out = [c.split()[0] for c in schema.split(", ")]
    rows = a.withColumn("_left", F.lit(True)).unionByName(b.withColumn("_left", F.lit(False)), allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        mine, theirs = t.filter(t["_left"]), t.filter(pc.invert(t["_left"]))
        theirs = theirs.sort_by(order)
        least, m = mine["least"].to_numpy(), theirs.num_rows
        for at, shared in strips(mine["words"], theirs["words"]):
            enough = np.flatnonzero(shared.max(1) >= least[at : at + len(shared)])
            if not len(enough):
                continue
            shared = shared if len(enough) == len(shared) else shared[enough]
            shared *= m
            shared += np.arange(m - 1, -1, -1)
            who = np.arange(len(shared))
            enough += at
            rows, found, times = [], [], []
            for _ in range(min(most, m)):
                j = shared.argmax(1)
                s = shared[who, j]
                shared[who, j] = -1
                ok = s >= least[enough] * m
                rows.append(enough[ok])
                found.append(j[ok])
                times.append(s[ok] // m)
            x, y = mine.take(np.concatenate(rows)), theirs.take(np.concatenate(found))
            cols = {"shared": pa.array(np.concatenate(times), pa.int32())} | {c: y[c] for c in ("other", *named)} | {c: x[c] for c in ("id", *by)}
            yield from pa.table({c: cols[c] for c in out}).to_batches()

    return grouped(rows, [*by, "_i", "_j"]).applyInArrow(run, schema)


def alike(rows: DataFrame, linked: DataFrame, by: list[str], run: Callable, schema: str) -> DataFrame:
    """`run` over the groups of all pairs of blocks of `rows` (`by`, id, words); `linked` (a, b) meets the pair of
    blocks that its rows are in, if they have one key. In a group `_side` is 0 for rows of the first block, 1 for those of the second (none, if
    the two are one) and 2 for links, with the columns id and other."""
    dealt = rows.join(sized(rows, by, "_n"), by).withColumn("_at", in_block("id", "_n"))
    first = dealt.select(*by, F.col("_at").alias("_i"), F.explode(F.sequence("_at", F.col("_n") - 1)).alias("_j"), F.lit(0).alias("_side"), "id", "words")
    second = dealt.where("_at > 0").select(*by, F.explode(F.sequence(F.lit(0), F.col("_at") - 1)).alias("_i"), F.col("_at").alias("_j"), F.lit(1).alias("_side"), "id", "words")
    kind = rows.schema["id"].dataType
    linked = linked.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    end = lambda c: dealt.select(*by, F.col("id").alias(c), F.col("_at").alias(f"_at_{c}"))
    met = linked.join(end("a"), "a").join(end("b"), ["b", *by])
    links = met.select(*by, F.least("_at_a", "_at_b").alias("_i"), F.greatest("_at_a", "_at_b").alias("_j"), F.lit(2).alias("_side"), F.col("a").alias("id"), F.col("b").alias("other"))
    both = first.unionByName(second).unionByName(links, allowMissingColumns=True)
    return grouped(both, [*by, "_i", "_j"]).applyInArrow(run, schema)


def pairs_alike(t: pa.Table, least: int, weight: int) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """Of a group of `alike`, strip by strip: the rows of both blocks, and the numbers and scores of pairs that have a
    word in common and reach `least` by up to `least` common words and `weight` for a link."""
    side = t["_side"].to_numpy()
    first, second, links = (t.filter(pa.array(side == k)) for k in range(3))
    one = t["_i"][0] == t["_j"][0]
    second = first if one else second
    i, j = (pc.index_in(links[c], first["id"]) for c in ("id", "other"))
    k, l = (pc.index_in(links[c], second["id"]) for c in ("id", "other"))  # noqa: E741
    whole = lambda x: pc.fill_null(x, -1).to_numpy().astype(np.int64)
    i, j, k, l = map(whole, (i, j, k, l))  # noqa: E741
    x, y = np.concatenate([i, j]), np.concatenate([l, k])  # a link either way
    ok = (x >= 0) & (y >= 0)
    cells = np.unique(x[ok] * second.num_rows + y[ok])
    x, y = cells // max(second.num_rows, 1), cells % max(second.num_rows, 1)
    for at, shared in strips(first["words"], second["words"]):
        a, b = np.searchsorted(x, (at, at + len(shared)))
        hit = shared >= least
        u, v = x[a:b] - at, y[a:b]
        count = shared[u, v]
        hit[u, v] = (count > 0) & (np.minimum(count, least) + weight >= least)
        if one:
            hit &= np.arange(shared.shape[1]) > np.arange(at, at + len(shared))[:, None]
        p, q = np.divmod(np.flatnonzero(hit), shared.shape[1])
        score = np.minimum(shared[p, q], least)
        if a < b:
            score[np.isin(p * shared.shape[1] + q, u * shared.shape[1] + v)] += weight
        yield first, second, p + at, q, score


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """`root`, the smallest member of each one's component, after a[k] and b[k] are joined for all k."""
    while True:
        a, b = root[a], root[b]
        far = a != b
        if not far.any():
            return root
        a, b = a[far], b[far]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
