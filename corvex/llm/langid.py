"""Language identification with a linear-chain conditional random field over words.

A word's features are the n-grams of its characters, of which those that touch its bounds are its affixes,
and the language of the lexicon that has it; the weights of features and of transitions between neighbouring
words are learned together, by gradient ascent of the likelihood that the forward-backward algorithm
gives. Training sequences are pieces of labelled texts, half of them spliced from two languages, so that
the field learns to switch. Forward-backward then labels every word of every whole text.

The field is fitted on at most SAMPLE labelled training documents of a language, those of the smallest hashes,
and of each on at most SAMPLE_CHARS characters, from a place that its hash tells; every language that training
documents have is learned. All documents are labelled, every word of them: texts are taken together up to CELLS
words by languages, and a longer text goes through forward-backward in blocks of so many, which pass their messages on.

Defined results: a word is a letter with the letters and marks that follow; a null text or one without letters is
`und` with score 0; documents with a null language are not learned from; without any training document all are
`und`; ties go to the first label in order; repeated rows are labelled one by one.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_column

FOLDS, HELD_OUT = 3, 1
SAMPLE, SAMPLE_CHARS = 200, 4_000
BITS, LONGEST = 16, 4  # feature buckets, n-grams
PIECE = 24  # words in a training sequence
THINNED = 4
EPOCHS, BATCH, RATE, DECAY = 4, 256, 0.3, 1e-4
LEXICON_COUNT, LEXICON_SHARE, LEXICON_WORDS = 3, 0.9, 5000
ROWS, CELLS = 2048, 1 << 22  # texts, and words by languages, labelled at once, at most
WORD, MARK = regex.compile(r"\p{L}[\p{L}\p{M}]*+"), regex.compile(r"\p{M}")
PLAIN = re.compile(r"[^\W\d_]+")  # the same where there are no marks and no numbers but digits
UND = "und"


def words(text: str | None) -> list[str]:
    low = (text or "").lower()
    found = PLAIN.findall(low)
    if not found or "".join(found).isalpha() and (low.isascii() or not MARK.search(low)):
        return found
    return WORD.findall(low)


def grams(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of all words one after the other, and where each word's begin."""
    joined = "".join([f"\x02{w}\x03" for w in distinct])
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 2
    end = np.repeat(np.cumsum(size), size)
    at, n = np.arange(len(c)), len(c)
    h, out = c.copy(), []
    for k in range(1, LONGEST + 1):
        if k > 1:
            h[: n - k + 1] = h[: n - k + 1] * np.uint64(0x100000001B3) + c[k - 1 :]
        mixed = ((h + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        out.append(np.where(at + k <= end, mixed.astype(np.int64), 1 << BITS))  # the last bucket weighs nothing
    return np.stack(out, axis=1).ravel(), (np.cumsum(size) - size) * LONGEST


@dataclass
class Field:
    labels: list[str]
    weights: np.ndarray  # feature buckets + 1, labels
    lexicon: dict[str, int]
    lexical: np.ndarray  # language of the lexicon (the last: none), labels
    moves: np.ndarray  # from, to
    first: np.ndarray

    def emissions(self, distinct: list[str]) -> np.ndarray:
        out = np.empty((len(distinct), len(self.labels)), np.float64)
        none = len(self.labels)
        for a in range(0, len(distinct), 8192):
            some = distinct[a : a + 8192]
            idx, start = grams(some)
            lex = np.fromiter((self.lexicon.get(w, none) for w in some), np.int64, len(some))
            out[a : a + len(some)] = np.add.reduceat(self.weights[idx], start) + self.lexical[lex]
        return out

    def marginals(self, sequences: list[np.ndarray]) -> list[np.ndarray]:
        """Of each sequence of emissions (words, labels), the labels' probabilities by word."""
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        size = np.array([len(sequences[i]) for i in order])
        width = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0))  # sequences longer than t
        start = np.concatenate([[0], np.cumsum(width)])
        e = np.empty((start[-1], len(self.labels)))
        slots = []
        for k, i in enumerate(order):
            slot = start[: size[k]] + k
            slots.append(slot)
            e[slot] = sequences[i]
        e = np.exp(e - e.max(axis=1, keepdims=True)) if len(e) else e
        move, fwd = np.exp(self.moves), np.empty_like(e)
        now = None
        for t, w in enumerate(width.tolist()):
            now = (np.exp(self.first) if now is None else now[:w] @ move) * e[start[t] : start[t] + w]
            now /= now.sum(axis=1, keepdims=True)
            fwd[start[t] : start[t] + w] = now
        back = np.ones((0, len(self.labels)))
        for t in range(len(width) - 1, -1, -1):
            w = int(width[t])
            full = np.ones((w, len(self.labels)))
            full[: len(back)] = back
            here = slice(start[t], start[t] + w)
            back = (full * e[here]) @ move.T
            back /= back.sum(axis=1, keepdims=True)
            fwd[here] *= full
        fwd /= fwd.sum(axis=1, keepdims=True)
        out: list = [None] * len(sequences)
        for k, i in enumerate(order):
            out[i] = fwd[slots[k]]
        return out

    def blocks(self, ids: np.ndarray, emissions: np.ndarray, size: int) -> Iterator[np.ndarray]:
        """The same for one long sequence of words, in blocks from the last to the first: a first pass keeps the
        forward message at each block's start, a second goes back and needs one block's at a time."""
        move, first = np.exp(self.moves), np.exp(self.first)

        def potentials(a):
            e = emissions[ids[a : a + size]]
            return np.exp(e - e.max(axis=1, keepdims=True))

        def forward(e, start):
            out, now = np.empty_like(e), start
            for t in range(len(e)):
                now = (first if now is None else now @ move) * e[t]
                now = out[t] = now / now.sum()
            return out

        starts, edges = [None], range(0, len(ids), size)
        for a in edges[:-1]:
            starts.append(forward(potentials(a), starts[-1])[-1])
        back = np.ones(len(self.labels))
        for a, start in zip(reversed(edges), reversed(starts)):
            e = potentials(a)
            p = forward(e, start)
            for t in range(len(e) - 1, -1, -1):
                p[t] *= back
                back = (back * e[t]) @ move.T
                back /= back.sum()
            yield p / p.sum(axis=1, keepdims=True)


def _lexicon(texts: list[list[str]], labels: list[int]) -> dict[str, int]:
    counts: dict[str, Counter] = {}
    for ws, y in zip(texts, labels):
        for w, n in Counter(ws).items():
            counts.setdefault(w, Counter())[y] += n
    by: dict[int, list] = {}
    for w, c in counts.items():
        y, n = max(c.items(), key=lambda x: (x[1], -x[0]))
        if n >= LEXICON_COUNT and n >= LEXICON_SHARE * c.total():
            by.setdefault(y, []).append((-n, w))
    return {w: y for y, found in by.items() for _, w in sorted(found)[:LEXICON_WORDS]}


def fit(texts: list[list[str]], tags: list[str], seed: int = 7) -> Field:
    """A field from texts (as words) and their languages."""
    labels = sorted(set(tags))
    n, y = len(labels), [labels.index(t) for t in tags]
    rng = np.random.default_rng(seed)
    pieces = [(t[a : a + PIECE], k) for t, k in zip(texts, y) for a in range(0, len(t), PIECE)]
    pieces = [p for p in pieces if p[0]]
    if not pieces:
        return Field([], np.zeros((1, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    rng.shuffle(pieces)
    sequences = []
    for a, b in zip(pieces, pieces[1:] + pieces[:1]):
        cut = PIECE if len(sequences) % 2 else int(rng.integers(1, PIECE))
        seq, tag = a[0][:cut], [a[1]] * len(a[0][:cut])
        if cut < PIECE:
            seq, tag = seq + b[0][: PIECE - len(seq)], tag + [b[1]] * len(b[0][: PIECE - len(seq)])
        sequences.append((seq, tag))
    f = Field(labels, np.zeros(((1 << BITS) + 1, n)), _lexicon(texts, y), np.zeros((n + 1, n)), np.zeros((n, n)), np.zeros(n))
    params = (f.weights, f.lexical, f.moves, f.first)
    past = [np.full_like(p, 1e-2) for p in params]
    for _ in range(EPOCHS):
        rng.shuffle(sequences)
        for a in range(0, len(sequences), BATCH):
            for p, g, s in zip(params, _gradient(f, sequences[a : a + BATCH]), past):
                g = g - DECAY * p
                s += g * g
                p += RATE * g / np.sqrt(s)
            f.weights[-1] = 0
    return f


def _gradient(f: Field, batch) -> tuple[np.ndarray, ...]:
    """Observed less expected counts of features, lexicon entries, transitions and starts."""
    n, ids = len(f.labels), {}
    longest = max(len(s) for s, _ in batch)
    word = np.zeros((longest, len(batch)), np.int64)
    tag = np.full((longest, len(batch)), -1)
    for k, (s, t) in enumerate(batch):
        word[: len(s), k] = [ids.setdefault(w, len(ids)) for w in s]
        tag[: len(s), k] = t
    distinct, live = list(ids), tag >= 0
    e = f.emissions(distinct)
    e = np.exp(e - e.max(axis=1, keepdims=True))[word]
    move, fwd, back = np.exp(f.moves), np.empty_like(e), np.ones_like(e)
    for t in range(longest):
        x = (np.exp(f.first) if t == 0 else fwd[t - 1] @ move) * e[t]
        fwd[t] = x / x.sum(axis=1, keepdims=True)
    for t in range(longest - 2, -1, -1):
        x = (back[t + 1] * e[t + 1]) @ move.T
        back[t] = np.where(live[t + 1][:, None], x / x.sum(axis=1, keepdims=True), 1.0)
    p = fwd * back
    p /= p.sum(axis=2, keepdims=True)
    delta = np.eye(n)[np.maximum(tag, 0)] - p
    delta[~live] = 0
    moves = np.zeros((n, n))
    for t in range(longest - 1):
        both = live[t + 1]
        x = fwd[t][both][:, :, None] * move[None] * (e[t + 1] * back[t + 1])[both][:, None, :]
        moves -= (x / x.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        np.add.at(moves, (tag[t][both], tag[t + 1][both]), 1)
    by_word = np.stack([np.bincount(word[live], delta[live][:, k], len(distinct)) for k in range(n)], axis=1)
    idx, start = grams(distinct)
    spread = np.repeat(by_word, np.diff(np.append(start, len(idx))), axis=0)
    weights = np.stack([np.bincount(idx, spread[:, k], len(f.weights)) for k in range(n)], axis=1)
    lexical = np.zeros_like(f.lexical)
    np.add.at(lexical, [f.lexicon.get(w, n) for w in distinct], by_word)
    return weights / len(batch) * 16, lexical / len(batch) * 16, moves / len(batch) * 16, delta[0].sum(axis=0) / len(batch) * 16


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Field:
    """Fit on a bounded sample, of each language, of the labelled documents that are not held out."""
    ident = F.col(f"`{id_col}`").cast("bigint")
    lang, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    fold = F.crc32(F.encode(F.coalesce(ident.cast("string"), F.lit("")), "utf-8")) % FOLDS
    own = F.xxhash64(ident, text)
    pool = docs.where((fold != HELD_OUT) & lang.isNotNull() & (F.octet_length(text) > 0)).select(lang.alias("l"), text.alias("t"), own.alias("h"))
    sizes = {r.l: r.n for r in pool.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return fit([], [])
    # of each language, about THINNED times as many as are wanted go on, whatever its size, and of them SAMPLE
    bound = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, THINNED * SAMPLE / n))])
    thin = pool.where((F.col("h") / 2.0**64 + 0.5) <= bound[F.col("l")])
    room = F.greatest(F.length("t") - SAMPLE_CHARS + 1, F.lit(1))
    piece = F.substring("t", F.pmod("h", room.cast("bigint")).cast("int") + 1, F.lit(SAMPLE_CHARS))
    k = F.row_number().over(W.partitionBy("l").orderBy("h", "p"))
    rows = thin.select("l", "h", piece.alias("p")).withColumn("k", k).where(F.col("k") <= SAMPLE).orderBy("l", "k").collect()
    return fit([words(r.p) for r in rows], [r.l for r in rows])


def _spans(text: str | None, best: np.ndarray, labels: list[str]) -> list[dict]:
    if not len(best):
        return []
    cut = np.flatnonzero(np.append(True, best[1:] != best[:-1]))
    # lowering may change a text's length; places are those of the lowered text where it does
    at = [m.span() for m in WORD.finditer(text.lower())]
    return [{"start": at[a][0], "end": at[b - 1][1], "lang": labels[best[a]]} for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(best)])]


def identify(docs: DataFrame, field: Field, text_col: str = "text", carry: list[str] | None = None, spans: bool = False) -> DataFrame:
    """`carry` (default: all columns) plus lang_pred and score, the label of the largest mean probability
    over the words and that mean; with `spans`, also the stretches of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(field)  # its size is fixed by BITS, LEXICON_WORDS and the number of languages

    def make():
        f = shared.value
        room = max(1, CELLS // max(1, len(f.labels)))

        def some(texts):
            ids: dict[str, int] = {}
            seqs = []
            for t in texts:
                seqs.append(np.array([ids.setdefault(w, len(ids)) for w in t], np.int64))
            if not f.labels or not ids:
                return [(UND, 0.0, ()) for _ in texts]
            e = f.emissions(list(ids))
            out = [(UND, 0.0, ()) for _ in texts]
            if len(seqs) == 1 and len(seqs[0]) > room:
                total, best = np.zeros(len(f.labels)), []
                for p in f.blocks(seqs[0], e, room):
                    total += p.sum(axis=0)
                    best.append(p.argmax(axis=1).astype(np.int16 if len(f.labels) < 1 << 15 else np.int32))
                found = [(0, total / len(seqs[0]), np.concatenate(best[::-1]))]
            else:
                full = [i for i, s in enumerate(seqs) if len(s)]
                found = [(i, p.mean(axis=0), p.argmax(axis=1)) for i, p in zip(full, f.marginals([e[seqs[i]] for i in full]))]
            for i, mean, best in found:
                k = int(mean.argmax())
                out[i] = (f.labels[k], float(min(mean[k], 1.0)), best)
            return out

        def fn(texts):
            out, batch, size = [], [], 0
            for t in texts:
                w = words(t)
                if batch and size + len(w) > room:
                    out += some(batch)
                    batch, size = [], 0
                batch.append(w)
                size += len(w)
            out += some(batch) if batch else []
            return [x[:2] + (_spans(t, x[2], f.labels),) for t, x in zip(texts, out)] if spans else [x[:2] for x in out]

        return fn

    fields = [("lang_pred", "string"), ("score", "double")]
    if spans:
        fields.append(("spans", "array<struct<start:int,end:int,lang:string>>"))
    return map_column(docs, [text_col], docs.columns if carry is None else carry, fields, make, ROWS)
