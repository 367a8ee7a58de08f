"""Quality rules as a short-circuit cascade.

Each rule's cost and selectivity are estimated on a bounded sample from all partitions; the rules then run in the
order of rejections per second, each after those before it, and a document's first failing rule ends its evaluation.
As it comes from measured times, the order may differ between runs: it changes the time and the named rule, never
the verdict.

Defined results: a null or empty text has no words and fails the rule on length; repeated rows are judged
one by one; an empty table gives an empty table; extra columns are kept; of those
named as a result (such as `kept`) the result takes the place.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_column

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 400  # about so many rows are timed, and one of each partition


class TextStats:
    """Measures of one text, each computed when a rule first asks for it."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.encode("utf-8", "surrogatepass").split()  # bytes split at \x20 and \x09-\x0D only

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, SPACES))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_bangs(self) -> int:
        return self.text.count("!")

    @cached_property
    def lines(self) -> list[str]:
        return [x for x in self.text.split("\n") if x.strip(SPACES)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        w = self.words
        grams = list(zip(w, w[1:], w[2:]))
        if len(set(grams)) == len(grams):
            return 0
        count, total, end = Counter(grams), 0, 0
        for i, g in enumerate(grams):
            if count[g] > 1:
                total += i + 3 - max(i, end)
                end = i + 3
        return total


#: What a measure is computed from, in an order in which each comes after its own.
BUILT_FROM = {
    "words": (), "n_words": ("words",), "word_chars": (), "n_symbols": (), "n_bangs": (), "lines": (), "n_dup_lines": ("lines",), "n_repeat_words": ("words",),
}


@dataclass(frozen=True)
class Rule:
    name: str
    needs: tuple[str, ...]
    rejects: Callable[[TextStats], bool]
    base: bool = False

    def measures(self) -> list[str]:
        """All measures that the rule needs, with what they are computed from."""
        wanted = set(self.needs) | {x for m in self.needs for x in BUILT_FROM[m]}
        return [m for m in BUILT_FROM if m in wanted]


RULES = (
    Rule("short", ("n_words",), lambda s: s.n_words < 50, base=True),
    Rule("repetition", ("n_words", "n_repeat_words"), lambda s: 100 * s.n_repeat_words > 50 * s.n_words, base=True),
    Rule("symbols", ("n_words", "n_symbols"), lambda s: 10 * s.n_symbols > s.n_words),
    Rule("duplicate_lines", ("lines", "n_dup_lines"), lambda s: 2 * s.n_dup_lines > len(s.lines)),
    Rule("exclamations", ("n_words", "n_bangs"), lambda s: 10 * s.n_bangs > s.n_words),
    Rule("word_length", ("n_words", "word_chars"), lambda s: not 2 * s.n_words <= s.word_chars <= 15 * s.n_words),
)


@dataclass(frozen=True)
class Estimate:
    name: str
    seconds: float  # a row, beyond what the rules before it have computed
    rejected: int  # of the rows that the rules before it let through
    rows: int

    @property
    def value(self) -> float:
        return (self.rejected + 0.5) / (self.rows + 1) / max(self.seconds, 1e-9)


def sample(docs: DataFrame, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first texts of each partition, about `rows` in all: from all files, of which the first Arrow batch of each
    partition is read."""
    text = docs.select(F.col(f"`{text_col}`").alias("text"))
    each = -(-rows // max(1, text.rdd.getNumPartitions()))

    def first(batches):
        left = each
        for b in batches:
            yield b.slice(0, left)
            left -= min(left, b.num_rows)
            if not left:
                return

    return text.mapInArrow(first, "text string")


def estimate(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> list[Estimate]:
    """The order of the cascade. In tasks, each measure is timed on the sample's texts and each rule judges them; of
    the rules left, the next is that which rejects most of the rows left for the time that its measures take, those
    apart that are computed by then."""
    measures = [m for m in BUILT_FROM if any(m in r.measures() for r in rules)]

    def make():
        def one(text):
            stats, seconds = TextStats(text), []
            for m in measures:
                began = time.perf_counter()
                getattr(stats, m)
                seconds.append(time.perf_counter() - began)
            return seconds, [bool(r.rejects(stats)) for r in rules]

        return lambda texts: [one(t) for t in texts]

    seen = map_column(sample(docs, text_col), ["text"], [], [("s", "array<double>"), ("v", "array<boolean>")], make)
    # how often each combination of verdicts comes (at most SAMPLE_ROWS and a row for each partition), and the times
    found = seen.groupBy("v").agg(F.count("*").alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(len(measures))]).collect()
    rows = sum(r.n for r in found)
    cost = {m: sum(r[f"s{i}"] for r in found) / max(rows, 1) for i, m in enumerate(measures)}
    left, known, out = dict(enumerate(rules)), set(), []
    while left:
        tried = {}
        for i, r in left.items():
            seconds = sum(cost[m] for m in r.measures() if m not in known)
            tried[i] = Estimate(r.name, seconds, sum(x.n for x in found if x.v[i]), sum(x.n for x in found))
        best = min(tried, key=lambda i: (-tried[i].value, tried[i].name))
        out.append(tried[best])
        known.update(left.pop(best).measures())
        found = [x for x in found if not x.v[best]]
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def cascade(
    docs: DataFrame,
    text_col: str = "text",
    carry: list[str] | None = None,
    rules: tuple[Rule, ...] = RULES,
    measures: bool = False,
) -> DataFrame:
    """`carry` (default: all columns) plus kept boolean and failed_rule string; with `measures`, also the
    base measures and base_failed, which then are computed for every row."""
    by_name = {r.name: r for r in rules}
    order = [by_name[e.name] for e in estimate(docs, text_col, rules)]
    fields = [("kept", "boolean"), ("failed_rule", "string")]
    if measures:
        fields += [(m, "bigint") for m in MEASURES] + [("base_failed", "boolean")]

    def make():
        def one(t):
            s = TextStats(t)
            failed = next((r.name for r in order if r.rejects(s)), None)
            row = (failed is None, failed)
            if measures:
                row += tuple(getattr(s, m) for m in MEASURES) + (any(r.rejects(s) for r in rules if r.base),)
            return row

        return lambda texts: [one(t) for t in texts]

    return map_column(docs, [text_col], docs.columns if carry is None else carry, fields, make)
