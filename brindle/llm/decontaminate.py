"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as UTF-8 after lower-casing, with every run of other ASCII characters than letters and digits as one
space. Items longer than SEGMENT bytes are cut into overlapping segments, so that long parts of an item are found too. A segment of m bytes within k
edits of a text shares at least m - q + 1 - k q of its q-grams with it, on diagonals (text position less segment position) that
spread by at most k. Shared q-grams are counted in diagonal bands 2 (k + 1) wide that overlap by half, bands with enough are
regions, and a region is kept if a banded alignment of the segment (ends of the text free) needs at most k edits. k is EDITS of m,
whatever m is: q is Q for segments of WHOLE_Q bytes and more and SHORT_Q below. Where k is zero and the item is too short for
q-grams to tell anything (under EXACT_BELOW bytes), it is searched for exactly, as whole words.

Ties: of an item's equally good regions the one with most shared q-grams, then the first segment's leftmost; of equal alignments the
leftmost end. Which it is only shows in `start`, `end` and `edits`.

The benchmark is searched in blocks of at most BLOCK bytes of text: each block's index is of bounded size and goes to all tasks, and
each document is looked at whole, where it lies.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import pieces, table

Q, SHORT_Q = 8, 4
EDITS = 0.08
SEGMENT, STEP = 120, 60
#: Bytes from which segments have Q-grams enough, and below which EDITS of an item is less than one edit.
WHOLE_Q, EXACT_BELOW = 40, 13
BLOCK = 2 << 20
#: Pairs of equal q-grams that are counted at a time.
MOST_HITS = 1 << 22
#: Bytes of text looked at together.
PIECE = 1 << 18
_HASH, _SLOTS = np.uint64(0x9E3779B97F4A7C15), 20
_KEEP = bytes(c if c >= 0x80 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEEP).split())


def grams(text: bytes, q: int = Q) -> np.ndarray:
    """The q-grams (q: 4 or 8) of text, each as one integer."""
    n = len(text) - q + 1
    out = np.empty(max(0, n), "<u8")
    for at in range(min(q, len(out))):
        out[at::q] = np.frombuffer(text, f"<u{q}", count=(len(text) - at) // q, offset=at)
    return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of equal neighbours."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def align(segment: np.ndarray, text: np.ndarray, low: int, high: int, k: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the segment's best place in text on diagonals low to high (and k beyond), or None beyond k edits.

    What lies outside the text is padding that matches nothing: it costs as much as missing characters. A cell is its cost and,
    in the lower bits, the diagonal it started on, so one minimum carries both.
    """
    base, width = low - k, high - low + 2 * k + 1
    window = np.full(len(segment) + width, -1, np.int16)
    inner = text[max(0, base) : max(0, base + len(window))]
    window[max(0, -base) : max(0, -base) + len(inner)] = inner
    slot, one = np.arange(width, dtype=np.int64), 1 << 32
    slide = slot * one
    cell = slot.copy()
    for i, c in enumerate(segment.tolist()):
        step = cell + (window[i : i + width] != c) * one
        np.minimum(step[:-1], cell[1:] + one, out=step[:-1])  # a character of the segment is missing
        cell = np.minimum.accumulate(step - slide) + slide  # characters of the text in between
        if i & 15 == 15 and cell.min() >> 32 > k:
            return None
    at = int(cell.argmin())
    edits, start, end = int(cell[at]) >> 32, base + (int(cell[at]) & (one - 1)), base + len(segment) + at
    return (edits, max(0, start), max(0, min(len(text), end))) if edits <= k else None


class Segments:
    """The q-grams of segments [(item_id, bytes)]."""

    def __init__(self, segments: list[tuple[int, bytes]], q: int):
        self.q, self.ids, self.segments = q, [i for i, _ in segments], [np.frombuffer(s, np.uint8) for _, s in segments]
        m = np.array([len(s) for s in self.segments], np.int64)
        self.edits = (m * EDITS).astype(np.int64)
        self.least = np.maximum(1, m - q + 1 - self.edits * q)
        codes = [grams(s, q) for _, s in segments]
        each = np.concatenate(codes) if codes else np.zeros(0, "<u8")
        order = np.argsort(each, kind="stable")
        self.owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order].astype(np.int32)
        self.place = (np.concatenate([np.arange(len(c)) for c in codes])[order] if codes else np.zeros(0, np.int64)).astype(np.int32)
        self.codes, self.first, self.count = np.unique(each[order], return_index=True, return_counts=True)
        h = (self.codes * _HASH >> np.uint64(64 - _SLOTS)).astype(np.int64)
        self.slot = np.full(1 << _SLOTS, -1, np.int32)  # -1: no such q-gram, -2: several, looked up by bisection
        self.slot[h] = np.arange(len(h))
        self.slot[h[np.bincount(h, minlength=1 << _SLOTS)[h] > 1]] = -2

    def _cells(self, at: np.ndarray, slot: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells (segment, half a band) and the q-grams shared in them, some hits at a time: few cells hold many hits."""
        n = self.count[slot]
        upto = np.cumsum(n)
        keys, shared = [], []
        for s, m in zip(*_runs((upto - n) // MOST_HITS), strict=True):
            own = n[s : s + m]
            which = np.repeat(self.first[slot[s : s + m]] - np.cumsum(own) + own, own) + np.arange(own.sum())
            owner = self.owner[which].astype(np.int64)
            diagonal = np.repeat(at[s : s + m], own) - self.place[which] + SEGMENT  # never negative
            key = owner * most + diagonal // (self.edits[owner] + 1) + 1
            key.sort()
            edge, k = _runs(key)
            keys.append(key[edge])
            shared.append(k)
        if len(keys) == 1:
            return keys[0], shared[0]
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, np.concatenate(shared)).astype(np.int64)

    def find(self, joined: bytes, ends: np.ndarray, cleaned: list[bytes], seen: set) -> Iterator[tuple[int, int, int, int, int]]:
        """Rows of Index.find that aren't in seen yet; joined: the cleaned texts, each with a zero byte after it."""
        codes = grams(joined, self.q)
        slot = self.slot[codes * _HASH >> np.uint64(64 - _SLOTS)]
        at = np.flatnonzero(slot != -1)
        if not len(at):
            return
        slot, own = slot[at], codes[at]
        several = slot == -2
        slot[several] = np.minimum(np.searchsorted(self.codes, own[several]), len(self.codes) - 1)
        hit = self.codes[slot] == own
        at, slot = at[hit], slot[hit]
        if not len(at):
            return
        most = len(joined) + SEGMENT + 2
        key, shared = self._cells(at, slot, most)
        after = np.r_[key[1:] == key[:-1] + 1, False]  # a band is a cell with hits and the next
        total = shared + np.where(after, np.r_[shared[1:], 0], 0)
        seg, cell = key // most, key % most
        good = np.flatnonzero(total >= self.least[seg])
        good = good[np.lexsort((cell[good], seg[good], -total[good]))]
        for g in good.tolist():
            s = int(seg[g])
            k, pattern = int(self.edits[s]), self.segments[s]
            low = (int(cell[g]) - 1) * (k + 1) - SEGMENT
            high = low + 2 * (k + 1) - 1
            for row in range(int(np.searchsorted(ends, max(0, low - k), "right")), min(len(cleaned) - 1, int(np.searchsorted(ends, high + len(pattern) + k, "right"))) + 1):
                base = int(ends[row]) - len(cleaned[row]) - 1
                if (row, self.ids[s]) in seen or not cleaned[row]:
                    continue
                found = align(pattern, np.frombuffer(cleaned[row], np.uint8), low - base, high - base, k)
                if found:
                    seen.add((row, self.ids[s]))
                    yield row, self.ids[s], *found


class Index:
    """A block of items [(item_id, text)]. Items without a letter or digit aren't searched for: they hold nothing to find."""

    def __init__(self, items: list[tuple[int, str | None]]):
        long, short, self.words = [], [], {}
        for item, text in items:
            t = normal(text)
            if t and len(t) < EXACT_BELOW:
                self.words.setdefault(t, []).append(item)
            elif t:
                starts = [0] if len(t) <= SEGMENT else [*range(0, len(t) - SEGMENT, STEP), len(t) - SEGMENT]
                (long if len(t) >= WHOLE_Q else short).extend((item, t[s : s + SEGMENT]) for s in starts)
        self.parts = [Segments(found, q) for found, q in ((long, Q), (short, SHORT_Q)) if found]
        #: Numbers of words of the items that are looked up exactly.
        self.lengths = sorted({t.count(b" ") + 1 for t in self.words})

    def _exact(self, text: bytes) -> Iterator[tuple[int, int, int]]:
        """(item_id, start, end) of each short item's first place among text's words."""
        starts = [0, *(m.end() for m in re.finditer(b" ", text))]
        ends = [s - 1 for s in starts[1:]] + [len(text)]
        seen = set()
        for n in self.lengths:
            for s, e in zip(starts, ends[n - 1 :], strict=False):
                if e - s < EXACT_BELOW and (t := text[s:e]) in self.words and t not in seen:
                    seen.add(t)
                    yield from ((item, s, e) for item in self.words[t])

    def find(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item_id, edits, start, end) for each text and item found in it; start and end are bytes of the normalised text."""
        cleaned = [normal(t) for t in texts]
        joined = b"\0".join(cleaned) + b"\0"
        ends = np.cumsum([len(c) + 1 for c in cleaned])
        out, seen = [], set()
        for part in self.parts:
            out += part.find(joined, ends, cleaned, seen)
        if self.words:
            out += [(row, item, 0, s, e) for row, c in enumerate(cleaned) if c for item, s, e in self._exact(c) if (row, item) not in seen]
        return sorted(out, key=lambda x: (x[0], str(x[1])))


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """An index of each block of the benchmark; blocks are by hash, so that each holds about BLOCK bytes at most."""
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK) or 1
    for b in range(n):
        own = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).select("item_id", "text")
        yield Index(sorted((tuple(r) for r in own.collect()), key=str))  # of bounded size


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, start, end) for each document and benchmark item found in it.

    Null and empty texts contain nothing; null and empty items, or those without a letter or digit, are not searched for; repeated documents and items are reported each.
    An empty table on either side gives an empty result. Extra columns are ignored.
    """
    sc = docs.sparkSession.sparkContext
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for index in indexes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts, ids = batch.column(1).to_pylist(), batch.column(0).to_pylist()
                found = [(ids[i + r], *rest) for i, j in pieces(texts, PIECE) for r, *rest in shared.value.find(texts[i:j])]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(5)], names=["doc_id", "item_id", "edits", "start", "end"])

        part = source.mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")
        out = part if out is None else out.unionByName(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which a benchmark item is found."""
    sc = docs.sparkSession.sparkContext
    names = docs.columns
    for index in indexes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text")):
        shared = sc.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(names.index("text")).to_pylist()
                bad = {i + r for i, j in pieces(texts, PIECE) for r, *_ in shared.value.find(texts[i:j])}
                yield batch.filter(pa.array([k not in bad for k in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
