"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model of ORDER words with Dirichlet smoothing: below a history h, its shortened form h',

    P(w|h) = (c(hw) + K P(w|h')) / (c(h) + K),    P(w) = (c(w) + 1) / (N + V + 1),

with K of PRIORS by the length of h, and P(w|h) = P(w|h') where h was not seen. As an automaton: each history seen in training is a state; each
n-gram seen is an arc, weighted by its log-probability, to the state of its longest ending; a failure arc of
weight log K / (c(h) + K) leads from a history to its shortened form, and from the last of them to the
empty state, which has an arc for every token. A text is read once from left to right: the automaton keeps its
state, takes failure arcs until the state has an arc for the token, adds up weights and moves on. All texts of a
chunk are read side by side, a token of each in a step; a text of more than LANE tokens is read in several
lanes, each of which first reads the words before it, as the state depends on the last ORDER - 1 of them only.
A text begins in the state of the end of a text.

Counts cover all training documents and are never collected or broadcast. Documents are dealt into chunks by
a hash of id and text; a chunk sends its distinct n-grams with their training counts to shards, each once however
frequent, and gets the totals back; so it holds the part of the automaton that its own texts visit. Single tokens
are told apart by 64-bit hashes, longer n-grams by hashes of so many bits, which grow with the input, that one in
MISS n-grams is expected to meet another one's count.

Defined results: null and empty texts have one token, their end; a null id counts as the id '' and so as
training; ids of any type are taken as text; rows come out as often as they went in; without training documents
every probability is 1/1 for the one unknown class.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, deal, input_bytes, release

FOLDS, HELD_OUT = 7, 2
ORDER = 3
PRIORS = (500.0, 8.0)  # for histories of one word, and of two or more
LANE = 1024  # tokens read one after the other
MISS = 1 << 18
CHUNK_BYTES = 6 << 20  # of stored input in a chunk; texts take about twice that
LEAST_CHUNKS = 64
MOST_SHARDS = 4096  # of single tokens: every chunk hears from each of them
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """Words, ASCII capitals lowered; the end is not among them."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


END = b"\n"  # no word has this byte


class Level:
    """The distinct n-grams of one length: their first n - 1 tokens and their last n - 1 as numbers of the level
    below, the last token, a hash, the training count; and by place in the texts, the n-gram that ends there."""

    def __init__(self, at, prefix, suffix, last, key, seen):
        self.at, self.prefix, self.suffix, self.last, self.key, self.seen = at, prefix, suffix, last, key, seen


class Chunk:
    """The texts of a chunk as numbers; token 0 is the end of a text."""

    def __init__(self, ids: list, texts: list, order: int = ORDER):
        self.rows = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or "", texts[i] or ""))
        known = _Ids({END: 0})
        parts = [np.zeros(1, np.int32)]
        for i in self.rows:
            parts.append(np.fromiter(map(known.__getitem__, tokens(texts[i])), np.int32))
            parts.append(np.zeros(1, np.int32))
        self.flat = np.concatenate(parts)  # an end, then each text with its end
        self.size = np.array([len(p) + 1 for p in parts[1::2]])
        self.held = np.array([held_out(ids[i]) for i in self.rows])
        self.train = np.append(False, np.repeat(~self.held, self.size))
        self.n = len(known)
        place = np.arange(len(self.flat))
        ends = np.where(self.flat == 0, place, 0)
        back = place[1:] - np.maximum.accumulate(ends)[:-1]  # words since the end before, that end included
        key = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, self.n)
        none = np.zeros(self.n, np.int32)
        self.levels = [Level(self.flat, none, none, np.arange(self.n, dtype=np.int32), key, np.bincount(self.flat[self.train], minlength=self.n))]
        for k in range(2, order + 1):
            low = self.levels[-1]
            where = np.flatnonzero(back >= k - 1) + 1
            code = low.at[where - 1].astype(np.int64) * self.n + self.flat[where]
            code, first, inverse = np.unique(code, return_index=True, return_inverse=True)
            prefix, last = (code // self.n).astype(np.int32), (code % self.n).astype(np.int32)
            at = np.full(len(self.flat), -1, np.int32)
            at[where] = inverse
            h = low.key[prefix] * _A + self.levels[0].key[last]
            h ^= h >> np.uint64(31)
            h *= _B
            h ^= h >> np.uint64(32)
            self.levels.append(Level(at, prefix, low.at[where[first]], last, h, np.bincount(inverse[self.train[where]], minlength=len(code))))


def _pack(x: np.ndarray) -> bytes:
    """Non-negative integers in as few bytes each as the largest takes."""
    x = x.astype("<u8")
    w = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([w]) + np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :w]).tobytes()


def _unpack(b: bytes, n: int, at: int = 0) -> tuple[np.ndarray, int]:
    w = b[at]
    out = np.zeros((n, 8), np.uint8)
    out[:, :w] = np.frombuffer(b, np.uint8, n * w, at + 1).reshape(n, w)
    return out.view("<u8").ravel(), at + 1 + n * w


def _pack_counts(x: np.ndarray) -> bytes:
    """A byte each, and what does not fit one after them."""
    return np.minimum(x, 255).astype(np.uint8).tobytes() + x[x >= 255].astype("<u8").tobytes()


def _unpack_counts(b: bytes, n: int, at: int = 0) -> np.ndarray:
    x = np.frombuffer(b, np.uint8, n, at).astype(np.int64)
    big = np.flatnonzero(x == 255)
    x[big] = np.frombuffer(b, "<u8", len(big), at + n)
    return x


def _pack_sorted(keys: np.ndarray) -> bytes:
    return keys[:1].astype("<u8").tobytes() + _pack(np.diff(keys)) if len(keys) else b""


def _unpack_sorted(b: bytes, n: int) -> tuple[np.ndarray, int]:
    if not n:
        return np.zeros(0, np.uint64), 0
    gaps, end = _unpack(b, n - 1, 8)
    return np.cumsum(np.concatenate([np.frombuffer(b, "<u8", 1), gaps]), dtype=np.uint64), end


def _shard(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """By ranges of the keys, which have `bits` bits."""
    high = keys >> np.uint64(bits - 32) if bits > 32 else keys << np.uint64(32 - bits)
    return (high * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


MAIL = pa.schema([("level", pa.int64()), ("shard", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])
MAIL_DDL = "level bigint, shard bigint, chunk bigint, n bigint, blob binary"


def _mail(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [()] * len(MAIL)
    return pa.table([pa.array(c, type=f.type) for c, f in zip(cols, MAIL)], schema=MAIL)


def _read(t: pa.Table, order: int) -> Chunk:
    return Chunk(t.column("_cx_id").to_pylist(), t.column("_cx_text").to_pylist(), order)


def _sorted_keys(level: Level, k: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A level's hashes cut to `bits` bits (single tokens' are whole), in order, and that order."""
    keys = level.key if k == 1 else level.key >> np.uint64(64 - bits)
    by = np.argsort(keys, kind="stable")
    return keys[by], by


def _ask(word_shards: int, shards: int, bits: int, order: int):
    def run(key, t):
        release()
        c, chunk, rows = _read(t, order), key[0].as_py(), []
        for k, level in enumerate(c.levels, 1):
            keys, by = _sorted_keys(level, k, bits)
            seen, many = level.seen[by], word_shards if k == 1 else shards
            cuts = np.searchsorted(_shard(keys, 64 if k == 1 else bits, many), np.arange(many + 1)).tolist()
            for s, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a or k == 1:  # shards that have none of its words answer with their sums
                    rows.append((k, s, chunk, b - a, _pack_sorted(keys[a:b]) + _pack_counts(seen[a:b])))
        return _mail(rows)

    return run


def _answer(key, t):
    """Totals of the asked n-grams, after the shard's tokens and distinct tokens in training."""
    release()
    level, shard = key[0].as_py(), key[1].as_py()
    chunks, ns, blobs = (t.column(c).to_pylist() for c in ("chunk", "n", "blob"))
    keys, counts = [], []
    for n, b in zip(ns, blobs):
        k, at = _unpack_sorted(b, n)
        keys.append(k)
        counts.append(_unpack_counts(b, n, at))
    k, x = np.concatenate(keys), np.concatenate(counts)
    by = np.argsort(k, kind="stable")
    k = k[by]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    sums = np.add.reduceat(x[by], first) if len(k) else np.zeros(0, np.int64)
    total = np.empty(len(k), np.int64)
    total[by] = np.repeat(sums, np.diff(np.append(first, len(k))))
    head = np.array([sums.sum(), np.count_nonzero(sums)], "<u8").tobytes()
    ends = np.cumsum(ns).tolist()
    return _mail([(level, shard, c, n, head + _pack_counts(total[e - n : e])) for c, n, e in zip(chunks, ns, ends)])


class Automaton:
    """States are histories: 0 the empty one, then those of each length below the order that training has. Arcs
    are sorted by state and token."""

    def __init__(self, levels: list[Level], counts: list[np.ndarray], total: int, distinct: int, priors: tuple[float, ...] = PRIORS):
        self.n = len(levels[0].last)
        below = np.log10((counts[0] + 1.0) / (total + distinct + 1.0))  # log P of each n-gram of the level at hand
        self.word = below
        state = np.where(counts[0] > 0, np.arange(1, self.n + 1), 0)  # of each n-gram as a history
        if len(levels) == 1:  # no history matters
            state = np.zeros(self.n, np.int64)
        self.order, self.start, self.after, states = len(levels), int(state[0]), state, [np.zeros(1, np.int64)]
        fail, fail_weight = [np.zeros(1, np.int64)], [np.zeros(1)]
        keys, weights, targets = [], [], []
        used = 1
        for k in range(1, len(levels)):
            low, high, prior = levels[k - 1], levels[k], priors[min(k, len(priors)) - 1]
            have = counts[k - 1]
            fail.append(states[-1][low.suffix] if k > 1 else np.zeros(len(have), np.int64))
            with np.errstate(divide="ignore"):
                fail_weight.append(np.where(have > 0, np.log10(prior / (have + prior)), 0.0))
            states.append(state)
            used += len(have)
            shorter = below[high.suffix]
            h = have[high.prefix]
            p = np.where(h > 0, np.log10((counts[k] + prior * 10.0**shorter) / (h + prior)), shorter)
            seen = np.flatnonzero(counts[k] > 0)
            keys.append(state[high.prefix[seen]] * self.n + high.last[seen])
            weights.append(p[seen])
            suffix_state = state[high.suffix]
            if k + 1 < len(levels):
                state = np.where((counts[k] > 0) & (high.last != 0), used + np.arange(len(counts[k])), 0)
                targets.append(state[seen])
            else:
                targets.append(suffix_state[seen])
            below = p
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        key = np.concatenate([*keys, [-1]])  # one arc that nothing takes: texts may hold no n-gram of training
        by = np.argsort(key)
        self.key, self.weight, self.target = key[by], np.concatenate([*weights, [0.0]])[by], np.concatenate([*targets, [0]])[by]

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weights of reading a token in each state, and the states after it."""
        out, after = np.zeros(len(state)), np.empty(len(state), np.int64)
        todo = np.arange(len(state))
        while len(todo):
            s, w = state[todo], token[todo]
            empty = s == 0
            done = todo[empty]
            out[done] += self.word[w[empty]]
            after[done] = self.after[w[empty]]
            todo, s, w = todo[~empty], s[~empty], w[~empty]
            if not len(todo):
                break
            want = s * self.n + w
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[at] == want
            done = todo[hit]
            out[done] += self.weight[at[hit]]
            after[done] = self.target[at[hit]]
            todo, s = todo[~hit], s[~hit]
            out[todo] += self.fail_weight[s]
            state[todo] = self.fail[s]
        return out, after

    def read(self, flat: np.ndarray, size: np.ndarray, lane: int = LANE) -> np.ndarray:
        """The log-probability of each text; `flat` holds the texts' tokens one after the other."""
        begin, order = np.cumsum(size) - size, self.order
        lanes = -(-size // lane)
        text = np.repeat(np.arange(len(size)), lanes)
        part = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        warm = np.where(part > 0, order - 1, 0)  # tokens read before the lane's own
        at = begin[text] + part * lane - warm
        length = np.minimum(size[text] - part * lane, lane) + warm
        by = np.argsort(-length, kind="stable")
        text, warm, at, length = text[by], warm[by], at[by], length[by]
        state = np.where(warm > 0, 0, self.start)
        score = np.zeros(len(text))
        width = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0))  # lanes longer than t
        for t, w in enumerate(width.tolist()):
            weight, state[:w] = self.step(state[:w].copy(), flat[at[:w] + t].astype(np.int64))
            score[:w] += weight if t >= order - 1 else np.where(warm[:w] <= t, weight, 0.0)
        return np.bincount(text, score, len(size))


def _score(bits: int, order: int, priors: tuple[float, ...], out: pa.Schema, carried: int):
    def run(key, left, right):
        release()
        c = _read(left, order)
        rows = sorted(zip(right.column("level").to_pylist(), right.column("shard").to_pylist(), right.column("n").to_pylist(), right.column("blob").to_pylist()))
        counts, total, distinct = [], 0, 0
        for k, level in enumerate(c.levels, 1):
            mine = [(n, b) for lv, _, n, b in rows if lv == k]
            got = np.empty(len(level.key), np.int64)
            got[_sorted_keys(level, k, bits)[1]] = np.concatenate([_unpack_counts(b, n, 16) for n, b in mine]) if mine else np.zeros(0, np.int64)
            counts.append(got)
            if k == 1:
                sums = [np.frombuffer(b, "<u8", 2).tolist() for _, b in mine]
                total, distinct = sum(x for x, _ in sums), sum(y for _, y in sums)
        for level in c.levels:  # of no more use
            level.at = level.key = level.seen = None
        model, flat = Automaton(c.levels, counts, total, distinct, priors), c.flat[1:]
        start = np.cumsum(c.size) - c.size
        base = np.add.reduceat(model.word[flat], start)
        known = np.add.reduceat((counts[0][flat] > 0).astype(np.int64), start)
        score = model.read(flat, c.size)
        back = np.empty(len(c.rows), np.int64)
        back[np.array(c.rows)] = np.arange(len(c.rows))
        new = [c.held, c.size, known, np.full(len(c.rows), total), base, score]
        carry = [left.column(f"_cx_c{i}").cast(out[i].type) for i in range(carried)]
        return pa.table([*carry, *[pa.array(x[back], type=f.type) for x, f in zip(new, list(out)[carried:])]], schema=out)

    return run


FIELDS = [("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, order: int = ORDER, priors: tuple[float, ...] = PRIORS) -> DataFrame:
    """`carry` (default: all columns) plus FIELDS; scores are log10 probabilities of the whole text."""
    cols = [c for c in (docs.columns if carry is None else carry) if c not in {n for n, _ in FIELDS}]
    stored = input_bytes(docs, text_col)
    chunks = max(LEAST_CHUNKS, -(-stored // CHUNK_BYTES))
    word_shards = min(chunks, MOST_SHARDS)
    bits = min(max(stored.bit_length() + MISS.bit_length() - 1, 40), 64)  # n-grams are fewer than stored bytes
    ident = F.col(f"`{id_col}`").cast("string")
    view = docs.select(
        F.pmod(F.xxhash64(ident, F.col(f"`{text_col}`")), F.lit(chunks)).alias("_cx_chunk"), ident.alias("_cx_id"), F.col(f"`{text_col}`").alias("_cx_text"),
        *[F.col(f"`{c}`").alias(f"_cx_c{i}") for i, c in enumerate(cols)],
    )
    dealt = deal(view, chunks).groupBy("_cx_chunk")
    asked = dealt.applyInArrow(_ask(word_shards, chunks, bits, order), MAIL_DDL)
    told = asked.groupBy("level", "shard").applyInArrow(_answer, MAIL_DDL)
    out = T.StructType([*[T.StructField(c, view.schema[f"_cx_c{i}"].dataType) for i, c in enumerate(cols)], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in FIELDS]])
    return dealt.cogroup(told.groupBy("chunk")).applyInArrow(_score(bits, order, priors, arrow_schema(out), len(cols)), out)
