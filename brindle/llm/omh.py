"""Document fingerprints by Order MinHash (Marcais et al., 2019), in DataFrame functions only.

k-mers are K consecutive words (fewer words: the whole sequence), numbered by occurrence so that repeats count. Each of SLOTS slots
has an order of its own over all k-mers: their hashes on a ring, read clockwise from the slot's point. As hashes are random, each of
these orders is any permutation with equal chance; those of different slots depend on one another, as they are turns of one ring,
which leaves each slot's chance of agreeing what it is for independent orders. In each slot the TUPLE k-mers that come first are
kept, put back into text order, and hashed as a tuple with the slot's number. As the tuples keep the order of their k-mers, slots
agree in proportion to how much of the text is alike in content and order, which follows edit distance rather than set overlap.

A k-mer is one long: the upper 34 bits of its hash, then 30 bits for its position, so that arrays sort as plain longs and the first
k-mers after a point are found by bisection. Ties: of k-mers with equal hashes the one that stands first in the text comes first.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import WORD_GAP, longs, materialize, shuffle_partitions, table
from brindle.llm.sharding import interval, splitters

K = 5
SLOTS = 32
TUPLE = 2
PLACE_BITS = 30
#: Blocks of neighbouring ids: about so many bytes of text.
BLOCK_BYTES = 8 << 20
_PLACE = (1 << PLACE_BITS) - 1


def points() -> list[int]:
    """The slots' places on the ring of signed longs."""
    return [(xxhash.xxh64_intdigest(b"slot", k) & ~_PLACE) - (1 << 63) for k in range(SLOTS)]


def _kmers(df: DataFrame, text: str, to: str) -> DataFrame:
    """Column `to`: the sorted array of packed, occurrence-numbered k-mers of column `text` (not null)."""
    bare = F.trim(F.regexp_replace(F.col(text), WORD_GAP, " "))
    words = F.transform(F.split(bare, " "), lambda w: F.xxhash64(w))
    h = F.col(f"{to}_h")
    df = df.withColumn(f"{to}_h", F.when(bare == "", F.array().cast("array<bigint>")).otherwise(words))
    pack = lambda value, at: value.bitwiseAND(~_PLACE).bitwiseOR(at.cast("long"))
    windows = F.transform(F.slice(h, F.lit(1), F.size(h) - (K - 1)), lambda x, i: pack(F.xxhash64(x, *[F.get(h, i + j) for j in range(1, K)]), i))
    short = F.when(F.size(h) > 0, F.array(pack(F.xxhash64(h), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(f"{to}_s", F.sort_array(F.when(F.size(h) >= K, windows).otherwise(short)))
    s = F.col(f"{to}_s")
    value = lambda x: F.shiftright(x, PLACE_BITS)
    #: How many equal k-mers stand before: the largest n with an equal one n places earlier in the sorted array, by bisection.
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(PLACE_BITS))])
    before = lambda x, i: F.aggregate(steps, F.lit(0), lambda n, step: F.when((n + step <= i) & (value(F.get(s, i - n - step)) == value(x)), n + step).otherwise(n))
    twin = lambda x, i: (i > 0) & (value(F.get(s, i - 1)) == value(x))
    again = F.transform(s, lambda x, i: F.when(twin(x, i), pack(F.xxhash64(value(x), before(x, i)), x.bitwiseAND(_PLACE))).otherwise(x))
    repeats = F.size(F.array_distinct(F.transform(s, value))) < F.size(s)
    return df.withColumn(to, F.when(repeats, F.sort_array(again)).otherwise(s)).drop(f"{to}_h", f"{to}_s")


def _signature(df: DataFrame, kmers: str, to: str) -> DataFrame:
    """Column `to`: a hash for each slot; empty where there is no k-mer."""
    s, n = F.col(kmers), F.size(kmers)
    place = lambda x: x.bitwiseAND(_PLACE)
    value = lambda x: F.shiftright(x, PLACE_BITS)
    steps = F.filter(F.array(*[F.lit(1 << b) for b in reversed(range(PLACE_BITS))]), lambda step: step <= n)
    df = df.withColumn(f"{to}_steps", steps)
    first = lambda p: F.aggregate(f"{to}_steps", F.lit(0), lambda at, step: F.when((at + step <= n) & (F.get(s, at + step - 1) < p), at + step).otherwise(at))
    df = df.withColumn(f"{to}_at", F.transform(longs(points()), first))

    def pair(at: Column, slot: Column) -> Column:
        x, y = F.get(s, at % n), F.get(s, (at + 1) % n)
        both = F.when(place(x) < place(y), F.xxhash64(slot, value(x), value(y))).otherwise(F.xxhash64(slot, value(y), value(x)))
        return F.when(n == 1, F.xxhash64(slot, value(x))).otherwise(both)

    none = F.array().cast("array<bigint>")
    return df.withColumn(to, F.when(n == 0, none).otherwise(F.transform(f"{to}_at", pair))).drop(f"{to}_at", f"{to}_steps", kmers)


def fingerprint(df: DataFrame, text: str, to: str) -> DataFrame:
    """df with the signature of column `text` (not null) as array `to`. Equal texts have equal signatures; a text without words has an empty one."""
    return _signature(_kmers(df, text, f"{to}_k"), f"{to}_k", to)


def likeness(a: str, b: str) -> Column:
    """The share of equal slots; 1 if neither side has a k-mer, 0 if one hasn't."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.lit(float(SLOTS)))


def _next(column: str) -> Column:
    """The column of the row before this one in the order of (__k1, __k2); a block's last row has the next block's first as its ghost."""
    return F.lead(column).over(Window.partitionBy("__to").orderBy("__ghost", F.desc("__k1"), F.desc("__k2")))


def in_blocks(docs: DataFrame) -> DataFrame:
    """docs (__k1, __k2, __size and others), each row in a block __to of neighbouring keys of near equal bytes, and the first row of
    the block that follows as its __ghost: all rows' nexts are at hand. The only exchange of texts.
    """
    light = materialize(docs.select("__k1", "__k2", "__size"), "ids")
    total, rows = light.agg(F.sum("__size"), F.count("*")).first()
    blocks = max(1, min(max(4 * shuffle_partitions(docs.sparkSession), (total or 0) // BLOCK_BYTES), (rows or 0) // 4))
    cuts, _ = splitters(light, blocks, 0.25, (total or 0) + 1)
    own = interval(cuts)
    firsts = {r[0]: (r[1][0], r[1][1]) for r in light.groupBy(own.alias("b")).agg(F.max(F.struct("__k1", "__k2"))).collect()}  # a row for each block
    order = sorted(firsts, reverse=True)
    before = {b: order[k - 1] for k, b in enumerate(order)}
    every = range(len(cuts) + 1)
    first1, first2, prior = (longs([f(b) for b in every]) for f in (lambda b: firsts.get(b, (0, 0))[0], lambda b: firsts.get(b, (0, 0))[1], lambda b: before.get(b, 0)))
    b = F.col("__block")
    is_first = (F.get(first1, b) == F.col("__k1")) & (F.get(first2, b) == F.col("__k2"))
    place = lambda block, ghost: F.struct(block.cast("long").alias("b"), F.lit(ghost).alias("ghost"))
    places = F.when(is_first, F.array(place(b, False), place(F.get(prior, b), True))).otherwise(F.array(place(b, False)))
    return docs.withColumn("__block", own).withColumn("__place", F.explode(places)).select("*", F.col("__place.b").alias("__to"), F.col("__place.ghost").alias("__ghost")).drop("__place", "__block")


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Each row's fingerprint, its edited text's and their likenesses.

    Null texts count as empty; null ids come last in the order, rows of equal id by their text's hash; repeated rows follow each
    other, in one block. A single row is its own next. An empty table gives an empty result. Extra columns are ignored.
    """
    text, id_ = F.coalesce(F.col("text"), F.lit("")), F.col("doc_id").cast("long")
    least = docs.agg(F.min(id_)).first()[0] or 0
    rows = docs.select("doc_id", text.alias("t"), F.coalesce(id_, F.lit(max(least, 1 - (1 << 63)) - 1)).alias("__k1"), F.xxhash64(text).alias("__k2"), F.octet_length(text).cast("long").alias("__size"))
    pairs = in_blocks(rows).withColumn("next_t", _next("t"))
    n = F.length("t")
    taken = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("t", F.lit(1), n - taken), F.substring(F.coalesce("next_t", F.lit("")), F.lit(1), taken))
    found = fingerprint(fingerprint(pairs.withColumn("e", edited), "t", "fp"), "e", "efp")
    lean = found.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("e", 256).alias("edited_sha256"), "fp", "efp", "__to", "__ghost", "__k1", "__k2")
    return lean.withColumn("next_fp", _next("fp")).where(~F.col("__ghost")).drop("__to", "__ghost", "__k1", "__k2")


def _said(c: str) -> Column:
    return F.array_join(F.transform(c, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_likeness(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_chars", "edited_sha256", _said("fp").alias("fingerprint"), _said("efp").alias("edited_fingerprint"), likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"))
