"""Language-model scoring with a hierarchical Pitman-Yor model.

Restaurants: every token that is a context has a restaurant of its own; they share CLASSES class restaurants (by the hash of the
context's last two bytes), which are their parents and serve contexts that never occur in training; the classes share the root,
whose base is uniform over the vocabulary and one unknown word. Neither restaurants nor dishes are bounded.

Layout: map tasks count (word, context) pairs and send them, compressed, by the word's hash, so that all dishes of a word meet in one
bucket of about BUCKET_BYTES of text; a word that holds more than a share of a bucket is dealt once more by the context's class, and
its few root numbers go through the driver. Contexts' totals are summed by ranges of their keys and sent back to the buckets that
hold dishes of them. The seating after each sweep is stored in the shared folder, so no sweep is repeated for another.

Sampling: each Gibbs sweep seats all customers of every dish anew, first in the word contexts, then (customers: their tables) in the
classes, then in the root. Only the numbers of tables count, and they are drawn whole from their conditional distribution given the
weight of a new table (table counts as in Chen, Du and Buntine, 2011): by generalised Stirling numbers up to EXACT customers, beyond
that by the same numbers' contour integral. Totals are summed after each sweep and held fixed within one (as in approximate
distributed Gibbs sampling, Newman et al., 2009). Each draw is seeded by word, context and sweep: no Spark setting changes a score.

Scoring: a token's probability is the mean over the sampled seatings after BURN_IN. Pairs of word and context go to the words'
buckets with the numbers of their documents, and return as sums for each document. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, held_out, materialize, shuffle_partitions, table

CLASSES = 64
#: Discounts and strengths of root, classes and word contexts.
DISCOUNT, STRENGTH = (0.8, 0.8, 0.8), (1.0, 1.0, 1.0)
SWEEPS, BURN_IN = 3, 1
#: The first sweep whose seating is a sample.
FIRST = BURN_IN + 1
#: Customers of a dish up to which generalised Stirling numbers are tabulated.
EXACT = 1024
#: Text that a bucket's words stand for, and the documents (one in so many) in which words too frequent for one bucket are looked for.
BUCKET_BYTES, LOOKED_AT = 24 << 20, 64
#: Tokens and documents that a map task packs together, and bytes of text that are split at a time.
FLUSH_TOKENS, FLUSH_DOCS, PIECE = 3 << 19, 30_000, 4 << 20
#: Tokens of a pack whose pairs are sorted at a time (or one bucket's), and bytes of rows that are sent together.
SORTED_TOKENS, SENT_BYTES = 1 << 18, 1 << 20
#: The end of a text as a token; words hold no line break.
END = b"\n"
_END = xxhash.xxh64_intdigest(END)
_LOW = np.uint64(CLASSES - 1)

TYPES, SIDE, STATE, ASK, META, REPORT, TOTAL = range(7)
_ROW = "kind int, bucket int, seq long, a binary, b binary, c binary, d binary, e binary, f binary, g binary, x double, y double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}[x.split()[1]] for x in _ROW.split(", ")]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(_NAMES, _TYPES, strict=True)], names=_NAMES)


def _batches(rows: Iterable[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size >= SENT_BYTES:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One at a time: a batch holds all rows of a bucket, which are not copied together."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {n: column[k].as_py() for n, column in zip(batch.schema.names, batch.columns, strict=True)}


def _release() -> None:
    """Give freed memory back (Arrow's, then the C library's), so that a worker doesn't hold the most that each of its steps took."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def _z(values: np.ndarray) -> bytes:
    """Integers by their bytes' places, compressed: small ones take little."""
    if not len(values):
        return b""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _u(packed: bytes | None, kind: type) -> np.ndarray:
    if not packed:
        return np.zeros(0, kind)
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal values in a sorted array."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def _find(sorted_: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Indexes in a sorted array, -1 where absent."""
    if not len(sorted_):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
    return np.where(sorted_[at] == wanted, at, -1)


def _bits(n: int) -> int:
    return max(1, int(n).bit_length())


class _Classes(dict):
    """Classes by the last two bytes, kept: at most 65,793."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = xxhash.xxh32_intdigest(key, 5) % CLASSES
        return n


_CLASS_OF = _Classes()


def _class(word: bytes) -> int:
    return _CLASS_OF[word[-2:]]


@dataclass
class _Pack:
    """Tokens of some whole documents: local ids in one stream, each document closed by END (id 0)."""

    ids: np.ndarray
    sizes: np.ndarray
    doc_ids: pa.Array
    learn: np.ndarray
    h: np.ndarray
    cls: np.ndarray

    def keys(self) -> np.ndarray:
        """The local words as contexts: their hash, with the class in the lowest bits."""
        return (self.h | np.uint64(1 << 63)) & ~_LOW | self.cls.astype(np.uint64)

    def learned(self) -> np.ndarray:
        return np.repeat(self.learn, self.sizes)

    def before(self, at: np.ndarray) -> np.ndarray:
        """The contexts of tokens: the ids before them. Before the first is END, which is also the last."""
        return self.ids[at - 1]


def _packed(held: list[tuple]) -> _Pack:
    words = pa.chunked_array([w for *_, w in held], pa.binary()).dictionary_encode().unify_dictionaries()
    known = words.chunk(0).dictionary.to_pylist() if words.num_chunks else []
    n = np.concatenate([n for _, _, n, _ in held])
    ids = np.ones(int(n.sum()) + len(n), np.int32)
    ids[np.cumsum(n + 1) - 1] = 0
    word = ids == 1
    ids[word] += np.concatenate([c.indices.to_numpy() for c in words.chunks] or [np.zeros(0, np.int32)])
    h = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))
    cls = np.fromiter((_CLASS_OF[w[-2:]] for w in known), np.int64, len(known))
    learn = np.concatenate([x for _, x, _, _ in held])
    return _Pack(ids, n + 1, pa.concat_arrays([i for i, *_ in held]), learn, np.r_[np.uint64(_END), h], np.r_[_class(END), cls])


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[_Pack]:
    """From batches (doc_id, learn, text)."""
    held, tokens, docs = [], 0, 0
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        piece = np.maximum((np.cumsum(size) - size) // PIECE, np.arange(len(size)) // FLUSH_DOCS)
        for s, m in zip(*_runs(piece), strict=True):
            text = pc.ascii_trim_whitespace(pc.ascii_lower(batch.column(2).slice(s, m)))
            words = pc.ascii_split_whitespace(pc.if_else(pc.equal(text, ""), pa.scalar(None, text.type), text))
            n = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            learn = pc.fill_null(batch.column(1).slice(s, m), False).to_numpy(zero_copy_only=False).astype(bool)
            held.append((batch.column(0).slice(s, m), learn, n, words.flatten().cast(pa.binary())))
            tokens, docs = tokens + int(n.sum()) + int(m), docs + int(m)
            if tokens >= FLUSH_TOKENS or docs >= FLUSH_DOCS:
                pack, held, tokens, docs = _packed(held), [], 0, 0
                del text, words
                _release()
                yield pack
                del pack
                _release()
    if held:
        pack, held = _packed(held), []
        _release()
        yield pack
    _release()


def _mixed(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    z = a ^ (np.asarray(b).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(salt * 0xD1B54A32D192ED03 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def _uniform(word: np.ndarray, other: np.ndarray | int, salt: int) -> np.ndarray:
    """A number in [0, 1) for each pair, the same whatever the layout."""
    return (_mixed(word, other, salt) >> np.uint64(11)).astype(np.float64) * 2.0**-53


@dataclass
class _Layout:
    """Buckets, and the words (sorted hashes, at most a few for each bucket) that are dealt by the context's class too."""

    buckets: int = 1
    hot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def deal(self, pack: _Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token the place of its word by bucket and hash; the places' hashes and buckets."""
        own = np.flatnonzero(_find(self.hot, pack.h) >= 0)
        h = np.r_[pack.h, np.repeat(pack.h[own], CLASSES)]
        bucket = np.r_[pack.h >> np.uint64(33), _mixed(np.repeat(pack.h[own], CLASSES), np.tile(np.arange(CLASSES), len(own)), 1) >> np.uint64(33)] % np.uint64(self.buckets)
        order = np.lexsort((h, bucket))
        h, bucket = h[order], bucket[order].astype(np.int64)
        new = np.r_[True, (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])]
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(new) - 1
        out = place[pack.ids]
        if len(own):
            row = np.full(len(pack.h), -1, np.int32)
            row[own] = np.arange(len(own))
            at = np.flatnonzero(row[pack.ids] >= 0)
            out[at] = place[len(pack.h) + row[pack.ids[at]] * CLASSES + pack.cls[pack.before(at)]]
        return out, h[new], bucket[new]

    def part(self, keys: np.ndarray) -> np.ndarray:
        """The range of contexts' keys, in their order."""
        return ((keys >> np.uint64(33) & np.uint64((1 << 30) - 1)) * np.uint64(self.buckets) >> np.uint64(30)).astype(np.int64)


def _pairs(pack: _Pack, layout: _Layout, seq: int, docs: bool) -> Iterator[dict]:
    """Rows for the buckets: words (a), their numbers of contexts (b), the contexts' keys (c), each pair's context (d) and
    its count in training (e); with docs instead its number of documents (e), the documents (f) and counts in them (g).

    Some buckets' tokens are taken at a time, so that temporary arrays stay small however large the pack is.
    """
    place, h, bucket = layout.deal(pack)
    keys, low, wide = pack.keys(), _bits(len(pack.h)), _bits(len(pack.sizes)) if docs else 1
    last = np.repeat(np.arange(len(pack.sizes), dtype=np.int32), pack.sizes) if docs else pack.learned()
    first, _ = _runs(bucket)
    upto = np.cumsum(np.bincount(place, minlength=len(h)))
    for s, m in zip(*_runs(np.r_[0, upto][first] // SORTED_TOKENS), strict=True):
        at = np.flatnonzero((place >= first[s]) & (place < np.r_[first, len(h)][s + m]))
        code = place[at].astype(np.int64)
        code <<= low
        code |= pack.before(at)
        code <<= wide
        code |= last[at]
        del at
        yield from _pair_rows(code, h, bucket, keys, low, wide, seq, docs)


def _pair_rows(code: np.ndarray, h: np.ndarray, bucket: np.ndarray, keys: np.ndarray, low: int, wide: int, seq: int, docs: bool) -> Iterator[dict]:
    """Rows of tokens given as place, context and document (or whether it is learned from), packed in an integer each."""
    code.sort()
    if docs:
        start, times = _runs(code)
        code = code[start]
        doc = (code & (1 << wide) - 1).astype(np.uint16)
        code >>= wide
        start, n = _runs(code)
        ends = np.r_[start, len(doc)]
    else:
        learned = code & 1
        code >>= wide
        start, _ = _runs(code)
        n = np.add.reduceat(learned, start) if len(start) else learned
    code = code[start]
    word, ctx = code >> low, code & (1 << low) - 1
    for s, m in zip(*_runs(bucket[word]), strict=True):
        first, k = _runs(word[s : s + m])
        used, idx = np.unique(ctx[s : s + m], return_inverse=True)
        row = {"kind": ASK if docs else TYPES, "bucket": int(bucket[word[s]]), "seq": seq, "a": h[word[s : s + m][first]].tobytes(), "b": _z(k), "c": keys[used].tobytes(), "d": _z(idx), "e": _z(n[s : s + m])}
        if docs:
            row |= {"f": _z(doc[ends[s] : ends[s + m]]), "g": _z(times[ends[s] : ends[s + m]])}
        yield row


@cache
def _log_stirling(discount: float) -> np.ndarray:
    """[c, t]: log of the weight of all ways to seat c customers at t tables, new tables weighing 1."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(EXACT):
        t = np.arange(c + 1)
        out[c + 1, : c + 1] = out[c, : c + 1] + np.log(np.maximum(c - t * discount, 1e-300))
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c + 1, 1 : c + 2], out[c, : c + 1])
    out[1:, 0] = -np.inf
    return out


def _law(customers: int, new: float, discount: float) -> tuple[int, np.ndarray]:
    """Weights of the numbers of tables of a dish of any size, and the least of them. What is left out weighs under 1e-15.

    c customers sit at t tables with weight (new / d)^t / t! times the coefficient of z^c in F(z)^t, F(z) = 1 - (1 - z)^d. The
    coefficients are integrals over z = exp(-p), p on a parabola about the cut from 1 (Weideman and Trefethen, 2007) or, far from it,
    on a line, with 200 places; against tabulated Stirling numbers the total variation is about 1e-12.
    """
    c, d, scale = customers, discount, new / discount
    low, high = -60.0, 5.0  # log p of the saddle, where c customers are the mean
    for _ in range(60):
        mid = (low + high) / 2
        p = np.exp(mid)
        low, high = (mid, high) if np.log(new) - p + (d - 1) * np.log(-np.expm1(-p)) > np.log(c) else (low, mid)
    at = max(np.exp(high), 4 / c)
    y, z = -np.expm1(-at), np.exp(-at)
    f = 1 - y**d
    t0 = min(max(scale * f, 1.0), c)
    mean = z * d * y ** (d - 1) / f  # of a table's size
    width = 1 / np.sqrt(max(t0 * (mean + z * z * d * (1 - d) * y ** (d - 2) / f - mean * mean), 1e-9))
    if at < 0.2:
        u = (np.arange(200) + 0.5) / 200 * min(np.sqrt(1 + 45 / (c * at)), 6 * width / at if width < at / 6 else np.inf)
        p, step = at * (1 + 1j * u) ** 2, 1 + 1j * u
    else:
        p = at + 1j * (np.arange(200) + 0.5) / 200 * min(np.pi, 12 * width)
        step = np.ones(200)
    log_f = np.log(1 - (-np.expm1(-p)) ** d) - np.log(f)
    half, middle = 10 * np.sqrt(t0) + 20, round(t0)
    t = np.arange(max(1, int(t0 - half)), min(c, int(t0 + half)) + 1)
    upto = np.concatenate([(np.exp(np.outer(part - middle, log_f) + c * (p - at) + middle * log_f) * step).real.sum(axis=1) for part in np.array_split(t, len(t) // 4096 + 1)])
    weight = (t - middle) * np.log(scale * f) - np.cumsum(np.log(t))
    return int(t[0]), np.maximum(upto, 0.0) * np.exp(weight - weight.max())


def _draw_tables(customers: np.ndarray, new: np.ndarray, discount: float, uniform: np.ndarray) -> np.ndarray:
    """Numbers of tables of the dishes, from their distribution given the weights of a new table, by numbers in [0, 1)."""
    customers = customers.astype(np.int64)
    t = np.minimum(customers, 1)
    for k in np.flatnonzero(customers > EXACT):
        least, weight = _law(int(customers[k]), float(new[k]), discount)
        upto = np.cumsum(weight)
        t[k] = least + np.searchsorted(upto, uniform[k] * upto[-1], "right")
    some = np.flatnonzero((customers > 1) & (customers <= EXACT))
    some = some[np.argsort(customers[some], kind="stable")]
    for s, m in zip(*_runs(customers[some]), strict=True):
        c = int(customers[some[s]])
        each, ways = np.arange(1, c + 1), _log_stirling(discount)[c, 1 : c + 1]
        for k in range(s, s + m, step := max(1, (1 << 20) // c)):
            own = some[k : min(k + step, s + m)]
            weight = ways + np.log(new[own])[:, None] * each
            upto = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            t[own] = 1 + (upto[:, :-1] <= uniform[own][:, None] * upto[:, -1:]).sum(axis=1)
    return t


@dataclass
class _Totals:
    """Customers and tables after a sweep: of the classes, the root and, in it, the words dealt by class; these words' counts."""

    class_c: np.ndarray
    class_t: np.ndarray
    root_c: int
    root_t: int
    hot_c: np.ndarray
    hot_t: np.ndarray
    hot_n: np.ndarray


class Bucket:
    """One bucket's words and their dishes. rest_c and rest_t: customers and tables of the contexts."""

    def __init__(self, layout: _Layout, h: bytes = b"", n: bytes = b"", keys: bytes = b"", ctx: bytes = b"", cnt: bytes = b""):
        self.layout, self.h, k = layout, np.frombuffer(h, np.uint64), _u(n, np.int64)
        self.keys, self.leaf_ctx, self.leaf_n = np.frombuffer(keys, np.uint64), _u(ctx, np.int64), _u(cnt, np.int64)
        self.leaf_word = np.repeat(np.arange(len(k)), k)
        self.c = np.add.reduceat(self.leaf_n, np.cumsum(k) - k) if len(k) else np.zeros(0, np.int64)
        code = self.leaf_word * CLASSES + self.classes()[self.leaf_ctx]
        self.pairs, self.leaf_pair = np.unique(code, return_inverse=True)
        self.pair_word, self.pair_class = self.pairs // CLASSES, self.pairs % CLASSES
        self.hot = _find(layout.hot, self.h)
        self.rest_c, self.rest_t = np.zeros(len(self.keys)), {}

    @classmethod
    def of(cls, layout: _Layout, row: dict | None) -> Bucket:
        return cls(layout, row["a"], row["b"], row["c"], row["d"], row["e"]) if row else cls(layout)

    def classes(self) -> np.ndarray:
        return (self.keys & _LOW).astype(np.int64)

    def take(self, sides: list[dict]) -> None:
        """Totals of the contexts by sweep and range of keys."""
        sides = sorted(sides, key=lambda r: r["seq"])
        if c := [_u(r["b"], np.int64) for r in sides if r["b"]]:
            self.rest_c = np.concatenate(c).astype(np.float64)
        for k in {r["seq"] >> 32 for r in sides}:
            self.rest_t[k] = np.concatenate([_u(r["a"], np.int64) for r in sides if r["seq"] >> 32 == k]).astype(np.float64)

    def start(self) -> tuple[np.ndarray, ...]:
        """One table for each dish: tables of leaves, class dishes and words."""
        return np.ones(len(self.leaf_n), np.int64), np.ones(len(self.pairs), np.int64), np.ones(len(self.h), np.int64)

    def customers(self, state: tuple[np.ndarray, ...], totals: _Totals | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of class dishes and words; tables of words. Words dealt by class have theirs from the totals."""
        leaf_t, pair_t, root_t = state
        pair_n, root_n = np.bincount(self.leaf_pair, leaf_t, len(self.pairs)).astype(np.int64), np.bincount(self.pair_word, pair_t, len(self.h)).astype(np.int64)
        if totals is not None and len(self.layout.hot):
            own = self.hot >= 0
            root_n, root_t = np.where(own, totals.hot_c[self.hot], root_n), np.where(own, totals.hot_t[self.hot], root_t)
        return pair_n, root_n, root_t

    def sweep(self, k: int, state: tuple[np.ndarray, ...], totals: _Totals, vocabulary: int) -> tuple[np.ndarray, ...]:
        """All customers seated anew, given the totals after sweep k - 1."""
        (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
        pair_n, root_n, root_t = self.customers(state, totals)
        fresh0 = (s0 + d0 * totals.root_t) / (vocabulary + 1)
        p0 = (root_n - d0 * root_t + fresh0) / (s0 + totals.root_c)
        fresh1 = (s1 + d1 * totals.class_t[self.pair_class]) * p0[self.pair_word]
        p1 = (pair_n - d1 * state[1] + fresh1) / (s1 + totals.class_c[self.pair_class])
        leaf_t, many = np.ones(len(self.leaf_n), np.int64), np.flatnonzero(self.leaf_n > 1)
        fresh2 = (s2 + d2 * self.rest_t[k - 1][self.leaf_ctx[many]]) * p1[self.leaf_pair[many]]
        leaf_t[many] = _draw_tables(self.leaf_n[many], fresh2, d2, _uniform(self.h[self.leaf_word[many]], self.keys[self.leaf_ctx[many]], 3 * k))
        pair_n = np.bincount(self.leaf_pair, leaf_t, len(self.pairs)).astype(np.int64)
        pair_t = _draw_tables(pair_n, fresh1, d1, _uniform(self.h[self.pair_word], self.pair_class + 1, 3 * k + 1))
        root_n = np.bincount(self.pair_word, pair_t, len(self.h)).astype(np.int64)
        return leaf_t, pair_t, _draw_tables(root_n, np.full(len(self.h), fresh0), d0, _uniform(self.h, 0, 3 * k + 2))

    def totals(self, state: tuple[np.ndarray, ...]) -> np.ndarray:
        """Customers and tables (two rows) of the classes and the root without the words dealt by class; tokens and words
        without them; then for each of them customers in the root and tokens.
        """
        pair_n, root_n, root_t = self.customers(state, None)
        own, hot = self.hot >= 0, self.hot[self.hot >= 0]
        n = len(self.layout.hot)
        first = np.r_[np.bincount(self.pair_class, pair_n, CLASSES), root_n[~own].sum(), self.c[~own].sum(), np.bincount(hot, root_n[own], n)]
        second = np.r_[np.bincount(self.pair_class, state[1], CLASSES), root_t[~own].sum(), len(self.h) - own.sum(), np.bincount(hot, self.c[own], n)]
        return np.array([first, second], np.float64)

    def report(self, bucket: int, leaf_t: np.ndarray, first: bool) -> list[dict]:
        """The tables (and at first the customers) that the contexts have here, to the ranges of their keys."""
        t = np.bincount(self.leaf_ctx, leaf_t, len(self.keys)).astype(np.int64)
        c = np.bincount(self.leaf_ctx, self.leaf_n, len(self.keys)).astype(np.int64)
        part = self.layout.part(self.keys)
        return [{"kind": REPORT, "bucket": int(part[s]), "seq": bucket, "a": self.keys[s : s + m].tobytes(), "b": _z(t[s : s + m]), "c": _z(c[s : s + m]) if first else None} for s, m in zip(*_runs(part), strict=True)]


class _Predictive:
    """Mean predictive probabilities of a bucket's sampled seatings {sweep: state}."""

    def __init__(self, b: Bucket, states: dict[int, tuple], totals: dict[int, _Totals], vocabulary: int):
        (d0, d1, d2), (s0, s1, s2) = DISCOUNT, STRENGTH
        self.h, self.keys, self.pairs, self.c, self.hot = b.h, b.keys, b.pairs, b.c, b.layout.hot
        self.code = b.leaf_word * len(b.keys) + b.leaf_ctx
        self.any = next(iter(totals.values()))
        self.samples = []
        for k, t in totals.items():
            state = states.get(k, b.start())
            pair_n, root_n, root_t = b.customers(state, t)
            rest_t = b.rest_t.get(k, np.zeros(len(b.keys)))
            self.samples.append((
                np.r_[(root_n - d0 * root_t) / (s0 + t.root_c), 0.0],  # the last: not in the bucket
                (t.hot_c - d0 * t.hot_t) / (s0 + t.root_c),
                (s0 + d0 * t.root_t) / (s0 + t.root_c) / (vocabulary + 1),
                np.r_[(pair_n - d1 * state[1]) / (s1 + t.class_c[b.pair_class]), 0.0],
                (s1 + d1 * t.class_t) / (s1 + t.class_c),
                np.r_[(b.leaf_n - d2 * state[0]) / (s2 + b.rest_c[b.leaf_ctx]), 0.0],
                (s2 + d2 * rest_t) / (s2 + b.rest_c),
            ))

    def __call__(self, h: np.ndarray, keys: np.ndarray, word: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pairs of indexes into word hashes and contexts' keys: the words' training counts and the probabilities."""
        at, hot, room = _find(self.h, h), _find(self.hot, h), _find(self.keys, keys)
        cls = (keys & _LOW).astype(np.int64)[key]
        known, own = at[word] >= 0, room[key]
        at1 = np.where(known, _find(self.pairs, at[word] * CLASSES + cls), -1)
        at2 = np.where(known & (own >= 0), _find(self.code, at[word] * len(self.keys) + own), -1)
        p = np.zeros(len(word))
        for a0, hot0, b0, a1, b1, a2, b2 in self.samples:
            root = np.where(hot >= 0, np.r_[hot0, 0.0][hot], a0[at]) + b0
            p += a2[at2] + np.r_[b2, 1.0][own] * (a1[at1] + b1[cls] * root[word])
        count = np.where(hot >= 0, np.r_[self.any.hot_n, 0][hot], np.r_[self.c, 0][at])
        return count[word], p / len(self.samples)


def _merged(layout: _Layout, rows: list[dict]) -> dict:
    """One row of a bucket's dishes from the map tasks' pairs. Contexts without a learned pair stay, for scoring."""
    h, at = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows]), return_inverse=True)
    keys, key = np.unique(np.concatenate([np.frombuffer(r["c"], np.uint64) for r in rows]), return_inverse=True)
    codes, counts, i, j = [], [], 0, 0
    for r in rows:
        k = _u(r["b"], np.int64)
        n = _u(r["e"], np.int64)
        code = np.repeat(at[i : i + len(k)], k) * len(keys) + key[j : j + len(r["c"]) // 8][_u(r["d"], np.int64)]
        i, j = i + len(k), j + len(r["c"]) // 8
        codes.append(code[n > 0])
        counts.append(n[n > 0])
    code, n = np.concatenate(codes), np.concatenate(counts)
    del codes, counts
    wide = _bits(n.max(initial=1))
    if _bits(len(h) * len(keys)) + wide < 63:
        code = code << wide | n
        code.sort()
        n = code & (1 << wide) - 1
        code >>= wide
    else:
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
    start, _ = _runs(code)
    n, code = (np.add.reduceat(n, start), code[start]) if len(start) else (n, code)
    word = code // len(keys)
    first, k = _runs(word)
    return {"kind": TYPES, "bucket": rows[0]["bucket"], "seq": 0, "a": h[word[first]].tobytes(), "b": _z(k), "c": keys.tobytes(), "d": _z(code % len(keys)), "e": _z(n)}


def _by_bucket(df: DataFrame, buckets: int, f: Callable[[int, list[dict]], Iterator[dict]], by: str = "bucket") -> DataFrame:
    """f of each bucket's rows, by kind and seq; a bucket is a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(_rows(batches))
        _release()
        for row in f(rows[0][by], rows) if rows else ():
            yield _batch([row])
        rows.clear()
        _release()

    return df.repartitionById(buckets, F.col(by)).sortWithinPartitions("kind", "seq").mapInArrow(run, _ROW)


def _total_rows(total: np.ndarray) -> list[dict]:
    return [{"kind": TOTAL, "bucket": -1, "seq": r, "x": float(x), "y": float(y)} for r, (x, y) in enumerate(total.T)]


def _state_row(bucket: int, k: int, state: tuple[np.ndarray, ...]) -> dict:
    return {"kind": STATE, "bucket": bucket, "seq": k, "a": _z(state[0]), "b": _z(state[1]), "c": _z(state[2])}


def _state(row: dict) -> tuple[np.ndarray, ...]:
    return tuple(_u(row[c], np.int64) for c in "abc")


def _added(part: int, rows: list[dict], k: int) -> Iterator[dict]:
    """The buckets' reports on a range of keys, summed and sent back to them."""
    _, at = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in rows]), return_inverse=True)
    n = int(at.max(initial=-1)) + 1
    t = np.bincount(at, np.concatenate([_u(r["b"], np.int64) for r in rows]), n).astype(np.int64)
    c = np.bincount(at, np.concatenate([_u(r["c"], np.int64) for r in rows]), n).astype(np.int64) if k == 0 else None
    s = 0
    for r in rows:
        own = at[s : s + len(r["a"]) // 8]
        s += len(own)
        yield {"kind": SIDE, "bucket": r["seq"], "seq": k << 32 | part, "a": _z(t[own]), "b": _z(c[own]) if k == 0 else None}


def _frequent(rows: DataFrame, buckets: int) -> np.ndarray:
    """Hashes of words that seem to hold over an eighth of a bucket, from one document in LOOKED_AT. The layout alone depends on them."""
    if buckets == 1:
        return np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack in _packs(batches):
            n = np.bincount(pack.ids, minlength=len(pack.h))
            own = np.flatnonzero(n * 32 * buckets >= n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.uint64(0), pack.h[own]].view(np.int64)), pa.array(np.r_[n.sum(), n[own]].astype(np.int64))], names=["h", "n"])

    looked = rows.where(F.pmod(F.xxhash64("text"), F.lit(LOOKED_AT)) == 0).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("h") == 0, F.col("n"))).over(Window.partitionBy())
    found = looked.orderBy(F.desc("n")).limit(8 * buckets + 1).withColumn("all", total).where((F.col("h") != 0) & (F.col("n") * 8 * buckets >= F.col("all"))).collect()  # shares over 1 in 8 * buckets
    return np.sort(np.array([r["h"] for r in found], np.int64).view(np.uint64))


class Trained:
    """The learned model of rows (doc_id, learn, text): stored dishes (and the contexts of all rows), seatings and totals by sweep."""

    def __init__(self, rows: DataFrame):
        spark = rows.sparkSession
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.buckets = max(1, -(-size // BUCKET_BYTES))
        layout = self.layout = _Layout(self.buckets, _frequent(rows, self.buckets))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId() << 32
            for k, pack in enumerate(_packs(batches)):
                yield from _batches(_pairs(pack, layout, part | k, False))

        def merge(bucket: int, found: list[dict]) -> Iterator[dict]:
            row = _merged(layout, found)
            found.clear()
            _release()
            yield row
            b = Bucket.of(layout, row)
            yield from b.report(bucket, b.start()[0], True)
            yield from _total_rows(b.totals(b.start()))

        stored = materialize(_by_bucket(rows.mapInArrow(count, _ROW), self.buckets, merge), "types", "kind")
        self.types = stored.where(F.col("kind") == TYPES)
        self.sides, self.states, self.totals = [self._add(stored, 0)], [], [self._sum(stored, 0)]
        discard(stored, f"kind={REPORT}")
        for k in range(1, SWEEPS + 1):
            self._sweep(k)
            if 1 < k <= FIRST:  # the seating before isn't needed any more
                discard(self.states[k - 2], f"kind={STATE}")
            spark.sparkContext._jvm.System.gc()  # shuffles of finished sweeps are deleted once they are unreachable

    def sampled(self) -> dict[int, _Totals]:
        return {k: self.totals[k] for k in range(FIRST, SWEEPS + 1)}

    def _add(self, stored: DataFrame, k: int) -> DataFrame:
        reports = stored.where(F.col("kind") == REPORT)
        return materialize(_by_bucket(reports, self.buckets, lambda part, rows: _added(part, rows, k)), "sides")

    def _sum(self, stored: DataFrame, k: int) -> _Totals:
        found = stored.where(F.col("kind") == TOTAL).groupBy("seq").agg(F.sum("x"), F.sum("y")).collect()  # CLASSES + 2 rows and one for each frequent word
        out = np.zeros((2, CLASSES + 2 + len(self.layout.hot)))
        for r, x, y in found:
            out[:, r] = x, y
        hot_c, hot_n = out[0, CLASSES + 2 :].astype(np.int64), out[1, CLASSES + 2 :].astype(np.int64)
        if k == 0:
            self.tokens, self.vocabulary = int(out[0, CLASSES + 1] + hot_n.sum()), int(out[1, CLASSES + 1] + (hot_n > 0).sum())
            hot_t = np.minimum(hot_c, 1)
        else:
            fresh = (STRENGTH[0] + DISCOUNT[0] * self.totals[-1].root_t) / (self.vocabulary + 1)
            hot_t = _draw_tables(hot_c, np.full(len(hot_c), fresh), DISCOUNT[0], _uniform(self.layout.hot, 0, 3 * k + 2))
        return _Totals(out[0, :CLASSES], out[1, :CLASSES], int(out[0, CLASSES] + hot_c.sum()), int(out[1, CLASSES] + hot_t.sum()), hot_c, hot_t, hot_n)

    def _sweep(self, k: int) -> None:
        layout, totals, vocabulary = self.layout, self.totals[-1], self.vocabulary

        def sweep(bucket: int, rows: list[dict]) -> Iterator[dict]:
            b = Bucket.of(layout, rows[0])
            b.take([r for r in rows if r["kind"] == SIDE])
            state = next((_state(r) for r in rows if r["kind"] == STATE), None) or b.start()
            rows.clear()
            state = b.sweep(k, state, totals, vocabulary)
            yield _state_row(bucket, k, state)
            yield from b.report(bucket, state[0], False)
            yield from _total_rows(b.totals(state))

        rows = self.types.unionByName(self.sides[-1])
        if self.states:
            rows = rows.unionByName(self.states[-1])
        stored = materialize(_by_bucket(rows, self.buckets, sweep), "sweep", "kind")
        state = stored.where(F.col("kind") == STATE)
        state.stored_at = stored.stored_at
        self.sides.append(self._add(stored, k))
        self.totals.append(self._sum(stored, k))
        self.states.append(state)
        discard(stored, f"kind={REPORT}")

    def rows(self) -> DataFrame:
        """All that scoring needs, by bucket."""
        out = self.types.unionByName(self.sides[0])
        for k in self.sampled():
            out = out.unionByName(self.sides[k]).unionByName(self.states[k - 1])
        return out


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """A row for every row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The rows where learn holds are the training corpus. Null and empty texts are the end token alone. Repeated rows count as often
    as they occur. Without training rows every token has the base's and the model's only probability, 1. An empty table gives an
    empty result. Words are told apart by 64-bit hashes (contexts by 57 bits and their class). Extra columns are ignored. There are
    no ties: scores don't depend on any order beyond rounding.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), learn.alias("learn"), F.col("text").cast("string").alias("text"))
    model = Trained(rows)
    layout, buckets, sampled, vocabulary, tokens = model.layout, model.buckets, model.sampled(), model.vocabulary, model.tokens
    divisor = tokens + 0.5 * (vocabulary + 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for k, pack in enumerate(_packs(batches)):
            meta = pa.RecordBatch.from_arrays([pack.doc_ids, pa.array(pack.learn), pa.array(pack.sizes)], names=["doc_id", "learn", "n"])
            yield _batch([{"kind": META, "bucket": (part | k) % buckets, "seq": part | k, "a": meta.serialize().to_pybytes()}])
            yield from _batches(_pairs(pack, layout, part | k, True))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each pack the documents' (a) known tokens (b), base (c) and model (d) sums in this bucket."""
        types, sides, states, predict = None, [], {}, None
        for r in _rows(batches):
            if r["kind"] == TYPES:
                types = r
            elif r["kind"] == SIDE:
                sides.append(r)
            elif r["kind"] == STATE:
                states[r["seq"]] = _state(r)
            elif r["kind"] == META:
                yield _batch([r])
            else:
                if predict is None:
                    _release()
                    b = Bucket.of(layout, types)
                    b.take(sides)
                    predict = _Predictive(b, states, sampled, vocabulary)
                    b, types, sides, states = None, None, [], {}
                    _release()
                k, n = _u(r["b"], np.int64), _u(r["e"], np.int64)
                count, p = predict(np.frombuffer(r["a"], np.uint64), np.frombuffer(r["c"], np.uint64), np.repeat(np.arange(len(k)), k), _u(r["d"], np.int64))
                doc, times = _u(r["f"], np.uint16), _u(r["g"], np.int64)
                some = np.flatnonzero(np.bincount(doc))
                known, base, score_ = (np.bincount(doc, times * np.repeat(x, n))[some] for x in (count > 0, np.log10((count + 0.5) / divisor), np.log10(p)))
                yield _batch([r | {"a": _z(some.astype(np.uint16)), "b": _z(known.astype(np.int64)), "c": base.tobytes(), "d": score_.tobytes(), "e": None, "f": None, "g": None}])
        predict = None
        _release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each pack's documents with the sums of all buckets: its META row comes last."""
        parts: list[dict] = []
        for r in _rows(batches):
            if r["kind"] != META:
                parts.append(r)
                continue
            meta = pa.ipc.read_record_batch(pa.py_buffer(r["a"]), pa.schema([("doc_id", pa.int64()), ("learn", pa.bool_()), ("n", pa.int64())]))
            known, base, score_ = np.zeros((3, meta.num_rows))
            for x in parts:
                some = _u(x["a"], np.uint16)
                known[some] += _u(x["b"], np.int64)
                base[some] += np.frombuffer(x["c"])
                score_[some] += np.frombuffer(x["d"])
            parts = []
            arrays = [meta.column(0), pc.invert(meta.column(1)), meta.column(2), pa.array(known.astype(np.int64)), pa.array(np.full(meta.num_rows, tokens, np.int64)), pa.array(base), pa.array(score_)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    sent = model.rows().unionByName(rows.mapInArrow(send, _ROW)).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("kind", "seq").mapInArrow(answer, _ROW)
    back = sent.repartition(shuffle_partitions(spark), "seq").sortWithinPartitions("seq", "kind", "bucket")
    return back.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), ~held_out(F.col("doc_id"), 5, 1))
