"""Benchmark decontamination with one Aho-Corasick automaton over normalised test passages.

Words are runs of digits, ASCII letters (capitals lowered) and non-ASCII characters. Every window of WINDOW
consecutive words of a benchmark text (the whole text, if it has fewer) is a pattern over numbered words; each
document is normalised, scanned once, and the hits are mapped back to words and to character offsets of the original.

The automaton is built in each worker from broadcast items, so its size is checked: one has at most SHARD_NODES
nodes (about 100 bytes each), and longer items than that alone. A larger benchmark is dealt over several automata;
the documents pass through one of them at a time, with a checkpoint between, so that a worker never holds two, and
the driver never more than the items of one.

Defined results: a null or empty text has no words and is never contaminated; an item without words has no
window; items with equal windows are all reported; a null item id is reported as no item but its windows
hit; repeated rows are judged one by one.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_column

WINDOW = 13
SHARD_NODES = 8 << 20  # in one automaton, by an upper bound; a third of it is usual
MIN_SHARE = 20  # contaminated: hit words are at least one in so many

_TO_SPACE = bytes(c if chr(c).isdigit() or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(0x80)) + bytes(range(0x80, 0x100))
_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(0x100))
NORMAL = _LOWER.translate(_TO_SPACE)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    # after translation, only \x20 separates: 0x85 and 0xA0 are no spaces to bytes.split
    return (text or "").encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows(text: str | None, window: int = WINDOW) -> list[list[bytes]]:
    w = words(text)
    if not w:
        return []
    return [w[i : i + window] for i in range(max(1, len(w) - window + 1))]


def codes(n: int) -> tuple[int, Callable[[int], str]]:
    """For numbers below n, how many characters below 255 a code has, and the codes: each place has characters of its
    own, so a code is found at its place only and no node of the automaton has more than 255 children."""
    width = next(k for k in range(1, 9) if (255 // k) ** k >= n)
    base = 255 // width
    return width, lambda i: "".join([chr(d * base + i // base**d % base) for d in range(width)])


class Patterns:
    """The automaton over numbered words, which are written in codes of equal length. A pattern carries (number of
    words, sorted item ids)."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for w in windows(text, window):
                owners.setdefault(tuple(w), set()).update([item] if item is not None else [])
        known = dict.fromkeys(x for w in owners for x in w)
        self.width, code = codes(len(known))
        self.code = {x: code(i) for i, x in enumerate(known)}
        self.other = "\xff" * self.width  # words that no item has
        self.found = ahocorasick.Automaton()
        for w, ids in owners.items():
            self.found.add_word("".join([self.code[x] for x in w]), (len(w), tuple(sorted(ids))))
        if owners:
            self.found.make_automaton()

    def scan(self, w: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged ranges [first, last) of hit words, and the items hit."""
        if not w or not len(self.found):
            return [], set()
        get, other, ranges, items = self.code.get, self.other, [], set()
        for at, (n, ids) in self.found.iter("".join([get(x, other) for x in w])):
            last = at // self.width + 1
            ranges.append((last - n, last))
            items.update(ids)
        return merge(ranges), items


def merge(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def shards(benchmark: DataFrame, item_col: str, text_col: str, shard_nodes: int, window: int = WINDOW) -> Iterator[tuple[list[tuple], bool]]:
    """The benchmark's items in shards of at most `shard_nodes` nodes, or of one item, and whether it is the last.
    They are fetched shard by shard, by ranges of a hash that hold about half as much, so that the driver holds one."""
    b = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").alias("text"))
    b = b.where(F.col("text").isNotNull())
    total = int(b.agg(F.sum(F.octet_length("text"))).first()[0] or 0) * window  # a word takes two bytes at least, and mostly codes of two
    n = max(1, -(-2 * total // shard_nodes)) if total > shard_nodes else 1
    part = F.pmod(F.xxhash64("text"), F.lit(n))
    for i in range(n):
        yield [(r.item, r.text) for r in b.where(part == i).toLocalIterator()], i == n - 1


_BUILT: dict[str, Patterns] = {}  # of a worker: the last automaton


def _patterns(key: str, shared, window: int) -> Patterns:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(shared.value, window)
    return _BUILT[key]


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    bench_text_col: str = "text",
    carry: list[str] | None = None,
    window: int = WINDOW,
    shard_nodes: int = SHARD_NODES,
) -> DataFrame:
    """`carry` (default: all columns) plus n_words, n_hit, item_ids (sorted as strings), spans (character
    offsets of runs of hit words in the original text) and contaminated."""
    kept = list(docs.columns if carry is None else carry)
    state = ("_cx_hits", "array<struct<a:int,b:int>>"), ("_cx_items", "array<string>")
    sc = docs.sparkSession.sparkContext
    df = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("_cx_text"))
    df = df.withColumn("_cx_hits", F.lit(None).cast(state[0][1])).withColumn("_cx_items", F.lit(None).cast(state[1][1]))
    fields = [("n_words", "bigint"), ("n_hit", "bigint"), ("item_ids", "array<string>"), ("spans", "array<struct<start:int,end:int>>"), ("contaminated", "boolean")]
    for items, last in shards(benchmark, item_col, bench_text_col, shard_nodes, window):
        shared, key = sc.broadcast(items), uuid.uuid4().hex

        def make(shared=shared, last=last, key=key):
            patterns = _patterns(key, shared, window)

            def one(text, hits, ids):
                w = words(text)
                ranges, new = patterns.scan(w)
                found = merge(ranges + [(h["a"], h["b"]) for h in hits or []])
                items = sorted(new | set(ids or []))
                if not last:
                    return [{"a": x, "b": y} for x, y in found], items
                hit, spans = sum(y - x for x, y in found), []
                if found:
                    at = [m.span() for m in WORD.finditer(text)]
                    spans = [{"start": at[x][0], "end": at[y - 1][1]} for x, y in found]
                return len(w), hit, items, spans, hit > 0 and MIN_SHARE * hit >= len(w)

            return lambda *cols: [one(*row) for row in zip(*cols)]

        carried, out = (kept, fields) if last else ([*kept, "_cx_text"], list(state))
        df = map_column(df, ["_cx_text", "_cx_hits", "_cx_items"], carried, out, make)
        df = df if last else checkpoint(df)
    return df
