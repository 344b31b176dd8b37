"""SimHash near-duplicates found with covering locality-sensitive hashing.

Fingerprints: words are `[^\\x20\\x09-\\x0D]+` of the ASCII-lower-cased text, shingles are `width` words joined by a space
(repeats count; fewer words: the whole sequence), a bit is set if it is set in over half of the shingles' XXH64 values (seed 42).
A null, empty or blank text has fingerprint zero and is linked like any other.

Search: bit positions get vectors of radius + 1 bits and each nonzero vector v gives the mask of the positions whose vector has
an odd product with v (Pagh, CoveringLSH, SODA 2016). Any two fingerprints within the radius agree under at least one mask,
since up to `radius` vectors never span the whole space. Groups of equal masked values are compared blockwise and leave a
spanning forest, not pairs. A group of over GROUP fingerprints is covered once more by masks over its free bits; what then
meets has at most 2 ** 17 distinct values, so every group is bounded whatever the number of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import binaries, components, materialize, shuffle_partitions, spans, spread_join, table

GROUP = 512
#: Bytes of text hashed together; each shingle takes 64 counters for a moment.
PIECE = 1 << 18
SEED = 42


def fingerprints(texts: list[bytes | None], width: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHash of each UTF-8 text."""
    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for k, text in enumerate(texts):
        words = (text or b"").lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= width:
            hashes.append(digest(joined, SEED))
            counts[k] = 1
            continue
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        hashes += [digest(joined[i:j], SEED) for i, j in zip(starts[: 1 - width].tolist(), ends[width - 1 :].tolist(), strict=True)]
        counts[k] = len(words) - width + 1
    out = np.zeros(len(texts), np.uint64)
    if some := np.flatnonzero(counts).tolist():
        n = counts[some]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[some] = np.packbits(sums * 2 > n[:, None], axis=1).view(">u8").ravel()
    return out


def _hash_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Batches with the fingerprint of their last column in its place. Only some texts at a time are copied out of a batch."""
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        fps = np.concatenate([fingerprints(binaries(column.slice(i, j - i)), width) for i, j in spans(sizes.tolist(), PIECE)] or [np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def with_fingerprint(docs: DataFrame, columns: list[str], text: str = "text", width: int = 4) -> DataFrame:
    """The given columns of docs and fp, the fingerprint as a signed long."""
    source = docs.select(*columns, F.col(text).alias("__text"))
    schema = source.drop("__text").withColumn("fp", F.lit(0).cast("long")).schema
    return source.mapInArrow(lambda batches: _hash_batches(batches, width), schema)


@lru_cache(maxsize=4096)
def cover(fixed: int, radius: int) -> tuple[int, ...]:
    """Masks that cover all differences of up to radius among the bits outside `fixed`, each joined with `fixed`."""
    vectors = (1 << (radius + 1)) - 1
    free = [i for i in range(64) if not fixed >> i & 1]
    masks = []
    for v in range(1, vectors + 1):
        mask = fixed
        for k, i in enumerate(free):
            if ((k * 11 % vectors + 1) & v).bit_count() & 1:
                mask |= 1 << i
        masks.append(mask)
    return tuple(masks)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(values: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (value, smaller value) that join, within each group, all values connected by steps of at most radius bits."""
    label = np.arange(len(values))
    _, sizes = np.unique(group, return_counts=True)
    if len(sizes) == 1 and sizes[0] > GROUP:  # one large group, row by row
        steps = ((np.full(len(values) - i - 1, i), np.arange(i + 1, len(values))) for i in range(len(values) - 1))
    else:
        steps = ((at := np.flatnonzero(group[:-k] == group[k:]), at + k) for k in range(1, int(sizes.max(initial=1))))
    for i, j in steps:
        near = (np.bitwise_count(values[i] ^ values[j]) <= radius) & (label[i] != label[j])
        i, j = i[near], j[near]
        while len(i):
            low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
            np.minimum.at(label, high, low)
            while not np.array_equal(label, up := label[label]):
                label = up
            open_ = label[i] != label[j]
            i, j = i[open_], j[open_]
    away = np.flatnonzero(label != np.arange(len(values)))
    return values[away], values[label[away]]


def _search(rows: DataFrame, radius: int, refine: bool) -> DataFrame:
    """rows (mask, key, fp): links (a, b, over = 0) and, if refine, the rows of groups of over GROUP as (fp, mask, over = 1)."""
    n = shuffle_partitions(rows.sparkSession)
    dealt = rows.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(a, b, over):
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a).astype(np.uint64).view(np.int64)), pa.array(np.asarray(b).astype(np.uint64).view(np.int64)), pa.array(np.full(len(a), over, np.int32))], names=["a", "b", "over"])

        rest, large = np.zeros((0, 3), np.int64), None

        def done(block: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, (block[1:, :2] != block[:-1, :2]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(block)])
            group = np.repeat(np.arange(len(starts)), sizes)
            big = sizes > GROUP
            if refine and big.any():
                rows_ = block[np.repeat(big, sizes)]
                yield out(rows_[:, 2].view(np.uint64) if rows_.flags.c_contiguous else np.ascontiguousarray(rows_[:, 2]).view(np.uint64), np.ascontiguousarray(rows_[:, 0]).view(np.uint64), 1)
            elif big.any():
                for g in np.flatnonzero(big):
                    one = np.ascontiguousarray(block[starts[g] : starts[g] + sizes[g], 2]).view(np.uint64)
                    yield out(*_forest(one, np.zeros(len(one), np.int64), radius), 0)
            small = np.repeat((sizes > 1) & ~big, sizes)
            if small.any():
                yield out(*_forest(np.ascontiguousarray(block[small, 2]).view(np.uint64), group[small], radius), 0)

        for batch in batches:
            block = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            block = np.concatenate([rest, block]) if len(rest) else block
            if not len(block):
                continue
            if refine and large is not None:  # a group already known to be large goes on without being held
                cut = int(np.argmax(np.r_[(block[:, :2] != large).any(axis=1), True]))
                if cut:
                    yield out(np.ascontiguousarray(block[:cut, 2]).view(np.uint64), np.ascontiguousarray(block[:cut, 0]).view(np.uint64), 1)
                    block = block[cut:]
                if not len(block):
                    rest = block
                    continue
                large = None
            last = len(block) - int(np.argmax(np.r_[(block[::-1, :2] != block[-1, :2]).any(axis=1), True]))
            if last:
                yield from done(block[:last])
            rest = block[last:]
            if refine and len(rest) > GROUP:
                large = rest[0, :2].copy()
                yield out(np.ascontiguousarray(rest[:, 2]).view(np.uint64), np.ascontiguousarray(rest[:, 0]).view(np.uint64), 1)
                rest = rest[:0]
        if len(rest):
            yield from done(rest)

    return dealt.mapInArrow(run, "a long, b long, over int")


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """fps: distinct fingerprints (fp). Links (a, b) whose components are those of all pairs within the radius."""
    masks = F.array(*[F.lit(_signed(m)) for m in cover(0, radius)])
    rows = fps.select(F.explode(masks).alias("mask"), "fp").select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    first = materialize(_search(rows, radius, refine=True), "links")
    found = first.where("over = 0").select("a", "b")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            fixed = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for f in np.unique(fixed):
                own = fp[fixed == f]
                for mask in cover(int(f), radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), mask, np.uint64).view(np.int64)), pa.array((own & np.uint64(mask)).view(np.int64)), pa.array(own.view(np.int64))], names=["mask", "key", "fp"])

    over = first.where("over = 1").select("a", "b")
    if not over.isEmpty():
        second = _search(over.mapInArrow(again, "mask long, key long, fp long"), radius, refine=False)
        found = found.unionByName(second.select("a", "b"))
    return found.distinct()


def _hashed(docs: DataFrame, id_col: str, text: str, width: int) -> DataFrame:
    """Rows (doc_id, th, fp)."""
    return with_fingerprint(docs, [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th")], text, width)


def _classes(hashed: DataFrame, radius: int) -> DataFrame:
    """Classes (fp, least, n) of rows (doc_id, th, fp), which are read once: least is the smallest (no_id, doc_id, th) of the component, n the fingerprint's rows."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("least")
    distinct = materialize(hashed.groupBy("fp").agg(least, F.count("*").alias("n")), "fps")
    found = components(links(distinct.select("fp"), radius))
    root = materialize(distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")), "roots")
    low = root.groupBy("root").agg(F.min("least").alias("least"), F.count("*").alias("fps"))
    return materialize(spread_join(root.select("root", "fp", "n"), low, "root", "fps", root.count()).select("fp", "least", "n"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """Every row of docs as (doc_id, fp, component_id): the smallest id reachable over links of at most radius bits.

    Null ids keep their row; they take part in links, and a component without any id has component_id null. Repeated rows
    each get their row. An empty table gives an empty result. Extra columns are ignored.
    """
    hashed = materialize(_hashed(docs, id_col, text, width), "fp")
    return spread_join(hashed, _classes(hashed, radius), "fp", "n", hashed.count()).select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """docs with one row of each group of near duplicates: the smallest id (null last; of equal ids the smallest text hash, of equal rows any one)."""
    classes = _classes(_hashed(docs, id_col, text, width), radius)  # no file is written while texts are hashed
    kept = classes.select("least").distinct().select(F.coalesce("least.doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("least.th").alias("__th"))
    keyed = docs.withColumns({"__id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64(F.coalesce(F.col(text), F.lit("")))})
    nth = F.row_number().over(Window.partitionBy("__id", "__th").orderBy("__th"))  # of equal rows each task sends one
    return keyed.withColumn("__n", nth).where("__n = 1").join(kept, ["__id", "__th"], "left_semi").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
