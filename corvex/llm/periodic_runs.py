"""Periodic runs of words, by Crochemore's partition refinement.

Positions of equal factors of length p are a class. From p to p + 1 a class splits by the classes of its members'
successors, and of the parts into which a class has split all but the largest serve as splitters (smaller halves), so
that a position is looked at a logarithmic number of times. Classes keep their positions as linked lists: neighbours of
one class at distance p, at length p, are a square whose root is no power. Squares of one period at adjacent positions
are merged into a run. The texts of an Arrow batch are refined side by side in numpy; no text meets another, so there
is no shuffle, and room grows with the longest text alone.

Defined results: null, empty and blank texts have no words and no runs; repeated rows are judged one by one; an empty
table gives an empty one; other columns are kept as they are, and one named like a result (`n_words`, `runs`,
`collapsed`) is replaced. Ties: a run is named by its smallest period.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, ranges

LEAST = 12  # words of a run
SPACES = r"[\x20\x09-\x0D]+"
TEXT_BYTES = 4 << 20  # of texts refined side by side; a longer text is alone
NEAR = 4096  # gaps of the present range of lengths that wait unsorted
NONE = -1


class Gaps:
    """Pairs (position, distance to its neighbour), called up by distance in rising order. Distances wait in ranges
    from a power of two to the next; a range is sorted when it is reached."""

    def __init__(self, most: int):
        self.waiting: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(most.bit_length() + 2)]
        self.at = self.range = 0
        self.dist = self.pos = self.near_dist = self.near_pos = np.empty(0, np.int64)

    def add(self, pos: np.ndarray, dist: np.ndarray) -> None:
        while len(pos):
            k = int(dist.max()).bit_length()
            here = dist >= 1 << k - 1
            if k == self.range:
                self.near_pos, self.near_dist = np.append(self.near_pos, pos[here]), np.append(self.near_dist, dist[here])
            else:
                self.waiting[k].append((pos[here], dist[here]))
            pos, dist = pos[~here], dist[~here]

    def _sort(self, pos: np.ndarray, dist: np.ndarray) -> None:
        by = np.argsort(dist, kind="stable")
        self.pos, self.dist, self.at = pos[by], dist[by], 0

    def take(self, p: int) -> np.ndarray:
        """Positions whose neighbour was put down at distance p. To be asked for p = 1, 2, 3, ..."""
        if p.bit_length() != self.range:
            self.range = p.bit_length()
            told = self.waiting[self.range]
            self._sort(*(np.concatenate(x) for x in zip(*told))) if told else self._sort(self.pos[:0], self.dist[:0])
            self.near_pos, self.near_dist = self.pos[:0], self.dist[:0]
            told.clear()
        if len(self.near_pos) > NEAR:
            self._sort(np.append(self.pos[self.at :], self.near_pos), np.append(self.dist[self.at :], self.near_dist))
            self.near_pos, self.near_dist = self.pos[:0], self.dist[:0]
        end = int(np.searchsorted(self.dist, p, "right"))
        found, self.at = self.pos[self.at : end], end
        if len(self.near_pos):
            now = self.near_dist == p
            if now.any():
                found = np.append(found, self.near_pos[now])
                self.near_pos, self.near_dist = self.near_pos[~now], self.near_dist[~now]
        return found


class Partition:
    """Classes of equal factors of several word sequences; each sequence ends with a mark of its own."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        """codes: of the sequences one after the other, each with its mark; equal words of one sequence, and none
        else, share a code."""
        n = len(codes)
        self.head = np.zeros(n, bool)
        ends = np.cumsum(lengths + 1)
        self.head[np.append(0, ends[:-1])] = True
        self.limit = np.repeat(lengths // 2, lengths + 1)  # the greatest period that fits twice
        self.order = np.argsort(codes, kind="stable")  # a class is a stretch of it, named by the stretch's start
        self.place = np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        first = np.flatnonzero(np.append(True, np.diff(codes[self.order]) != 0))
        count = np.diff(np.append(first, n))
        self.size = np.zeros(n, np.int64)
        self.size[first] = count
        self.cls = np.empty(n, np.int64)
        self.cls[self.order] = np.repeat(first, count)
        self.next, self.prev = np.full(n, NONE), np.full(n, NONE)
        self.gaps = Gaps(int(self.limit.max(initial=1)))
        self.p = 1
        inner = np.append(np.diff(self.cls[self.order]) == 0, False)
        self._link(self.order[:-1][inner[:-1]], self.order[1:][inner[:-1]])
        self.split = np.arange(n)  # positions of the splitting classes, in order

    def _link(self, a: np.ndarray, b: np.ndarray) -> None:
        """b[k] follows a[k] in a class from now on."""
        new = (self.next[a] != b) & (b - a <= self.limit[a]) & (b - a >= self.p)
        self.next[a], self.prev[b] = b, a
        self.gaps.add(a[new], (b - a)[new])

    def squares(self) -> np.ndarray:
        """Where squares begin whose root has the present length and is no power, in order."""
        found = self.gaps.take(self.p)
        return np.sort(found[self.next[found] == found + self.p])

    def refine(self) -> None:
        """From factors of p words to factors of p + 1."""
        s = self.split[(self.limit[self.split] > self.p) & ~self.head[self.split]]
        t = s - 1
        many = self.size[self.cls[t]] > 1
        s, t = s[many], t[many]
        self.p += 1
        old = self.cls[t]
        by = np.argsort(old * len(self.cls) + self.cls[s], kind="stable")  # by class, part, position
        m, part, c = t[by], self.cls[s][by], old[by]
        if not len(m):
            self.split = m
            return
        new_class = np.append(True, c[1:] != c[:-1])
        new_part = new_class | np.append(True, part[1:] != part[:-1])
        at_class, at_part = np.flatnonzero(new_class), np.flatnonzero(new_part)
        moved, part_size = np.diff(np.append(at_class, len(m))), np.diff(np.append(at_part, len(m)))
        name = c[at_class]
        rest = self.size[name] - moved
        # the largest part of each class, its rest included, is no splitter
        owner = np.cumsum(new_class)[at_part] - 1
        largest = np.maximum.reduceat(part_size, np.flatnonzero(new_class[at_part]))
        rest_wins = rest >= largest
        k = np.flatnonzero((part_size == largest[owner]) & ~rest_wins[owner])
        best = np.full(len(name), NONE)
        best[owner[k[::-1]]] = k[::-1]  # of parts of one size the first
        # links: the rest closes over what leaves it, each part gets its own
        line = np.argsort(old, kind="stable")
        x, xc = t[line], old[line]
        begin = np.append(True, (xc[1:] != xc[:-1]) | (self.next[x[:-1]] != x[1:]))
        a, b = self.prev[x[begin]], self.next[x[np.append(begin[1:], True)]]
        both = (a != NONE) & (b != NONE)
        only_a, only_b = a[(a != NONE) & (b == NONE)], b[(b != NONE) & (a == NONE)]
        self._link(a[both], b[both])
        self.next[only_a], self.prev[only_b] = NONE, NONE
        last = np.append(new_part[1:], True)
        self._link(m[:-1][~last[:-1]], m[1:][~last[:-1]])
        self.next[m[last]], self.prev[m[new_part]] = NONE, NONE
        # stretches: what leaves goes to the end of its class's stretch, where others give way to the places left
        slots = ranges(name + rest, moved)
        there = self.order[slots]
        class_no = np.cumsum(new_class) - 1
        in_front = self.place[m] < (name + rest)[class_no]
        leaving, k = np.zeros(len(slots), bool), class_no[~in_front]
        leaving[(np.cumsum(moved) - moved - name - rest)[k] + self.place[m[~in_front]]] = True
        free, stay = self.place[m[in_front]], there[~leaving]
        self.order[free] = stay
        self.place[stay] = free
        self.order[slots], self.place[m] = m, slots
        self.size[name] = rest
        title = slots[at_part]
        self.size[title] = part_size
        self.cls[m] = np.repeat(title, part_size)
        # next splitters
        parts_of = np.bincount(owner, minlength=len(name)) + (rest > 0)
        chosen = parts_of[owner] > 1
        chosen[best[best != NONE]] = False
        keep = [m[np.repeat(chosen, part_size)]]
        small = ~rest_wins & (rest > 0)
        if small.any():
            keep.append(self.order[ranges(name[small], rest[small])])
        self.split = np.sort(np.concatenate(keep))


def runs_of(codes: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (in `codes`, which holds a mark after each sequence), lengths and periods of all runs, by start and period."""
    found = []
    if len(codes):
        e, most = Partition(codes, lengths), int((lengths // 2).max(initial=0))
        while e.p <= most and (len(e.split) or e.p == 1):
            at = e.squares()
            if len(at):
                cut = np.flatnonzero(np.append(True, np.diff(at) != 1))
                first, last = at[cut], at[np.append(cut[1:], len(at)) - 1]
                length = last - first + 2 * e.p
                k = length >= least
                found.append((first[k], length[k], np.full(int(k.sum()), e.p)))
            if e.p == most:
                break
            e.refine()
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, period = (np.concatenate(x) for x in zip(*found))
    by = np.lexsort((period, start))
    return start[by], length[by], period[by]


def _judge(texts: pa.Array, least: int) -> list[pa.Array]:
    parts = pc.split_pattern_regex(pc.fill_null(texts.cast(pa.large_string()), ""), SPACES)
    offsets, words = parts.offsets.to_numpy(), parts.flatten()
    offsets = offsets - offsets[0]
    full = pc.not_equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # before the first space, after the last
    before = np.append(0, np.cumsum(full))
    ends = before[offsets]
    lengths = np.diff(ends)
    words = words.filter(pa.array(full))
    coded = pc.dictionary_encode(words)
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, kinds = np.repeat(np.arange(len(lengths)), lengths), max(1, len(coded.dictionary))
    shift = np.arange(len(lengths))
    codes = np.empty(len(index) + len(lengths), np.int64)
    codes[np.arange(len(index)) + doc] = doc * (kinds + 1) + index
    codes[ends[1:] + shift] = shift * (kinds + 1) + kinds
    start, length, period = runs_of(codes, lengths, least)
    of = np.searchsorted(ends[1:] + shift, start, "left")
    gone = np.zeros(len(index) + 1, np.int64)
    np.add.at(gone, start + period - of, 1)
    np.add.at(gone, start + length - of, -1)
    kept = np.cumsum(gone)[:-1] == 0
    kept_ends = np.append(0, np.cumsum(kept))[ends]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept_ends, pa.int32()), words.filter(pa.array(kept))), pa.scalar(" ", pa.large_string()))
    rows = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start - of - ends[of], length, period)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(lengths) + 1)), pa.int32()), rows)
    return [pa.array(lengths, pa.int64()), runs, collapsed]


def find_runs(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, least: int = LEAST) -> DataFrame:
    """`carry` (default: all columns) plus n_words, runs array<struct<start, length, period>> (all long, by start, then
    period) and collapsed, the words that no run holds after its first period, joined by one space.

    Words are stretches without \\x20 and \\x09-\\x0D, numbered from 0. A run is a stretch of at least `least` words and
    twice its smallest period that no neighbouring word extends.
    """
    text = F.col(f"`{text_col}`").cast("string")
    fields = [("n_words", "bigint"), ("runs", "array<struct<start: bigint, length: bigint, period: bigint>>"), ("collapsed", "string")]
    return map_arrow(docs, text, docs.columns if carry is None else carry, fields, lambda: lambda texts: _judge(texts, least), TEXT_BYTES)


def longest(runs: Column) -> Column:
    """The run of greatest length (ties: smallest start, then period); null without runs."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with a periodic tail in about every tenth text, as a source of runs of any period.

    With h the crc32 of the id as text and g its tenth, a text of n words with h % 10 = 0 repeats from word a = g % n on
    its next p = 1 + (n - a) // (3 + g % 8) words to its end, all words joined by one space. Null ids are left alone.
    """
    h = F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "utf-8"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(f"`{text_col}`"), SPACES, -1), lambda w: w != "")
    at = docs.withColumn("_cx_w", F.when(h % 10 == 0, words)).withColumn("_cx_n", F.size("_cx_w"))
    at = at.withColumn("_cx_a", F.when(F.col("_cx_n") > 0, (g % F.col("_cx_n")).cast("int")))
    n, a, w = F.col("_cx_n"), F.col("_cx_a"), F.col("_cx_w")
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8)).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), n - a)
    text = F.when(a.isNotNull(), F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " ")).otherwise(F.col(f"`{text_col}`"))
    return at.withColumn(text_col, text).drop("_cx_w", "_cx_n", "_cx_a")
