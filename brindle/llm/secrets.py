"""Secret scan with corpus-wide ownership frequency.

Every whole text is searched for the base kinds (assign, access, hex) and for other key-like strings: runs of 20 or more
`[A-Za-z0-9+/_-]` with both letters and digits and at least ENTROPY bits a character. The values' hashes are counted over the whole
corpus by distinct repositories and owners. A value that more than MOST_OWNERS owners or more than MOST_REPOS repositories hold is a
widely copied example; the others are owner-specific and look live. Base spans always stay; the value of every owner-specific match,
base or key-like, is added as a span of kind `live`. Ties: spans are sets, ordered by start, then kind, then end.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import materialize, spread_join, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: The contract's `+` runs that are long enough: a run is maximal either way.
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
KEYLIKE = re.compile(r"[A-Za-z0-9+/_-]{20,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "live")
LEAST_ASSIGN = 8
ENTROPY = 3.5
MOST_OWNERS, MOST_REPOS = 2, 10
SCAN = "n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int,kind:int,end:int,at:int,upto:int,hash:long>>"


def base_spans(text: str) -> list[tuple[int, int, int, int, int, str]]:
    """(start, kind, end, the value's start, its end, value) of the base matches by start, then kind; offsets are code points, ends exclusive."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES):
        out += [(m.start(), 0, m.end(), *m.span(2), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span(), m[0]) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), *m.span(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def _entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def keylike(text: str, base: list[tuple]) -> list[tuple[int, int, int, int, int, str]]:
    """Key-like strings that don't touch a base span."""
    starts, upto = [x[0] for x in base], [*accumulate((x[2] for x in base), max)]  # upto: where the spans so far end
    out = []
    for m in KEYLIKE.finditer(text):
        v, before = m[0], bisect_left(starts, m.end())
        if any(map(str.isdigit, v)) and any(map(str.isalpha, v)) and _entropy(v) >= ENTROPY and not (before and upto[before - 1] > m.start()):
            out.append((m.start(), 3, m.end(), *m.span(), v))
    return out


def digest(spans: list[tuple]) -> str:
    return hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans).encode()).hexdigest()


def _scan(docs: DataFrame, keep: list[Column]) -> DataFrame:
    source = docs.select(*keep, F.col("text").alias("__text"))
    kept = source.drop("__text").schema
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [SCAN])
    found_type = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("at", pa.int32()), ("upto", pa.int32()), ("hash", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, found = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                text = text or ""
                base = base_spans(text)
                kinds = [x[1] for x in base]
                counts.append([kinds.count(k) for k in range(3)])
                shas.append(digest(base))
                found.append([{"start": s, "kind": k, "end": e, "at": a, "upto": b, "hash": xxhash.xxh64_intdigest(v) - (1 << 63)} for s, k, e, a, b, v in base + keylike(text, base)])
            arrays = [*batch.columns[:-1], *(pa.array([c[k] for c in counts], pa.int64()) for k in range(3)), pa.array(shas, pa.string()), pa.array(found, found_type)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    return source.mapInArrow(run, schema)


def ownership(found: DataFrame) -> DataFrame:
    """found (hash, repo, owner), a row for each occurrence: hash, repos, owners. A value that holds a third of the rows is pre-aggregated."""
    places = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    held = places.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return held.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"), F.sum("n").alias("n"))


def scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """A row for every row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied.

    spans holds kind:start:end by start, then kind, comma-joined. n_live and n_copied count the row's matches whose values are
    owner-specific and widely copied. Null texts count as empty; null owners (and repositories) are one owner (repository).
    Repeated rows each get a row. An empty table gives an empty result. In `documents` the source stands for the owner and the
    document for the repository.
    """
    keep = [F.col("doc_id").alias("doc_id"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.coalesce(F.col(repo).cast("string"), F.lit("")).alias("repo")]
    rows = materialize(_scan(docs, keep).withColumn("rid", F.monotonically_increasing_id()), "scan")
    each = rows.where(F.size("found") > 0).select("rid", "owner", "repo", F.explode("found").alias("f")).select("rid", "owner", "repo", "f.*")
    copied = (F.col("owners") > most_owners) | (F.col("repos") > most_repos)
    owners = materialize(ownership(each.select("hash", "owner", "repo")).select("hash", "n", copied.alias("copied")), "owners")
    total = owners.agg(F.sum("n")).first()[0] or 0
    judged = spread_join(each, owners, "hash", "n", total)
    base = F.collect_set(F.when(F.col("kind") < 3, F.struct("start", "kind", "end")))
    live = F.collect_set(F.when(~F.col("copied"), F.struct(F.col("at").alias("start"), F.lit(3).alias("kind"), F.col("upto").alias("end"))))
    spans = judged.groupBy("rid").agg(F.sort_array(F.concat(base, live)).alias("spans"), F.count(F.when(~F.col("copied"), 1)).alias("n_live"), F.count(F.when(F.col("copied"), 1)).alias("n_copied"))
    kind = F.array(*map(F.lit, KINDS))
    said = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", F.get(kind, s["kind"]), s["start"], s["end"])), ",")
    zero = F.lit(0).cast("long")
    out = rows.join(spans, "rid", "left")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(said, F.lit("")).alias("spans"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_copied", zero).alias("n_copied"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
