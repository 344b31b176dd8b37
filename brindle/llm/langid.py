"""Language identification by hierarchical discrimination.

Features are byte 2- and 3-grams of the whole lower-cased text (letters only, words apart by one space), hashed to DIM buckets.
First linear support vector machines, one for each language family against the rest, choose the family; then one-versus-one
machines separate the languages of that family, by votes and then by summed margins. All are trained by dual coordinate descent
(Hsieh et al., 2008) on the driver, from a bounded sample of the labelled rows: of every language that occurs at most PER_LANG
different texts, and fewer where all languages together would have over MOST_TEXTS (one at least), those with the smallest text
hash; a text counts once, however often it is copied. Every other step works on all rows, without a shuffle.

Ties: of equal margins the family, and of equal votes and margins the language, that comes first by name; a margin of zero between two
languages is a vote for the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import held_out, pieces, table

PER_LANG, MOST_TEXTS = 250, 8_000
BITS = 13
DIM = 2 << BITS
EPOCHS, COST = 12, 10.0
#: Steepness of the logistic function that makes a score of a margin.
SLOPE = 4.0
UNKNOWN = "und"
#: Texts that score below are rejected in a pipeline: either no family or no language of it has a positive margin.
LEAST_SCORE = 0.25

#: Language families by language code. A code that isn't here is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indo-aryan": "hi ur bn mr gu pa ne si",
    "iranian": "fa ku ps tg",
    "dravidian": "ta te kn ml",
    "semitic": "ar he am mt",
    "celtic": "ga gd cy br",
    "malayo-polynesian": "id ms jv tl",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_KEEP = bytes(c if c >= 0x80 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def _clean(text: str) -> bytes:
    return b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_KEEP).split()) + b" "


def _codes(cleaned: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the 2-grams and 3-grams at each byte of the joined texts (each padded by two spaces), and the texts' offsets."""
    sizes = np.fromiter((len(c) + 2 for c in cleaned), np.int64, len(cleaned))
    a = np.frombuffer(b"  ".join(cleaned) + b"    ", np.uint8).astype(np.uint32)
    two = a[:-2] << 8 | a[1:-1]
    three = two << 8 | a[2:]
    n = int(sizes.sum())
    return (two[:n] * np.uint32(2654435761)) >> np.uint32(32 - BITS), ((three[:n] * np.uint32(2246822519)) >> np.uint32(32 - BITS)) + np.uint32(1 << BITS), np.cumsum(sizes) - sizes


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and counts of one text."""
    two, three, _ = _codes([_clean(text)])
    idx, n = np.unique(np.concatenate([two, three]), return_counts=True)
    return idx.astype(np.int32), n.astype(np.float32)


def _train(xs: list[tuple[np.ndarray, np.ndarray]], y: list[int]) -> np.ndarray:
    """A linear support vector machine by dual coordinate descent on unit vectors."""
    w, alpha, order = np.zeros(DIM, np.float64), np.zeros(len(xs)), np.random.default_rng(1)
    for _ in range(EPOCHS):
        for i in order.permutation(len(xs)):
            idx, x = xs[i]
            g = y[i] * float(w[idx] @ x) - 1.0
            new = min(max(alpha[i] - g, 0.0), COST)
            if new != alpha[i]:
                w[idx] += (new - alpha[i]) * y[i] * x
                alpha[i] = new
    return w


class Model:
    """families: names; langs: each family's languages; root (DIM, families) and pairs[family] (DIM, pairs)."""

    def __init__(self, samples: list[tuple[str, np.ndarray, np.ndarray]]):
        unit = [(lang, (idx, n / np.linalg.norm(n))) for lang, idx, n in samples]
        #: Sums over a text are divided by its grams; this turns them to the scale of unit vectors.
        scale = float(np.median([n.sum() / np.linalg.norm(n) for _, _, n in samples])) if samples else 1.0
        of = lambda lang: FAMILY.get(lang, f"={lang}")
        by: dict[str, list] = {}
        for lang in sorted({lang for lang, _ in unit}):
            by.setdefault(of(lang), []).append(lang)
        self.families, self.langs = sorted(by), [by[f] for f in sorted(by)]
        xs = [x for _, x in unit]
        roots = [_train(xs, [1 if of(lang) == f else -1 for lang, _ in unit]) for f in self.families] if len(by) > 1 else []
        self.root = np.array(roots, np.float32).reshape(len(roots), DIM).T * np.float32(scale)
        self.pairs = []
        for langs in self.langs:
            ws = [_train([x for lang, x in unit if lang in two], [1 if lang == two[0] else -1 for lang, _ in unit if lang in two]) for two in combinations(langs, 2)]
            self.pairs.append(np.array(ws, np.float32).reshape(len(ws), DIM).T * np.float32(scale))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score (0 to 1) of each text; `und` and 0 without a letter or if nothing was learned."""
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        rows = [i for i, t in enumerate(texts) if self.families and has_letter(t)]
        if not rows:
            return labels, scores
        two, three, starts = _codes([_clean(texts[i]) for i in rows])
        sizes = np.diff(np.r_[starts, len(two)])

        def margins(w: np.ndarray, which: np.ndarray) -> np.ndarray:
            chosen = np.repeat(which, sizes)
            s = sizes[which]
            return np.add.reduceat(w[two[chosen]] + w[three[chosen]], np.cumsum(s) - s, axis=0) / (2 * s[:, None])

        every = np.ones(len(rows), bool)
        root = margins(self.root, every) if self.root.shape[1] else np.ones((len(rows), 1), np.float32)
        family = root.argmax(axis=1)
        sure = 1 / (1 + np.exp(-SLOPE * root.max(axis=1).astype(np.float64))) if self.root.shape[1] else np.ones(len(rows))
        for f in np.unique(family):
            own, langs = family == f, self.langs[f]
            if len(langs) == 1:
                best, inner = np.zeros(int(own.sum()), int), np.ones(int(own.sum()))
            else:
                m = margins(self.pairs[f], own).astype(np.float64)
                votes, total = np.zeros((len(m), len(langs))), np.zeros((len(m), len(langs)))
                for k, (a, b) in enumerate(combinations(range(len(langs)), 2)):
                    votes[:, a] += m[:, k] > 0
                    votes[:, b] += m[:, k] <= 0
                    total[:, a] += m[:, k]
                    total[:, b] -= m[:, k]
                best = (votes + np.tanh(total) / 4).argmax(axis=1)
                inner = 1 / (1 + np.exp(-SLOPE * total[np.arange(len(m)), best] / (len(langs) - 1)))
            for i, b, s in zip(np.flatnonzero(own), best, inner * sure[own], strict=True):
                labels[rows[i]], scores[rows[i]] = langs[b], float(min(max(s, 0.0), 1.0))
        return labels, scores


def train(docs: DataFrame, usable: Column, per_lang: int = PER_LANG, most_texts: int = MOST_TEXTS) -> Model:
    """A model of the rows of docs where usable holds and lang and text aren't null. The driver gets a row for each language."""
    spark = docs.sparkSession
    labelled = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text", F.xxhash64(F.lit(3), "text").alias("h"))
    counts = labelled.groupBy("lang").agg(F.approx_count_distinct("h")).collect()
    if not counts:
        return Model([])
    per_lang = max(1, min(per_lang, most_texts // len(counts)))
    parts = spark.createDataFrame([(lang, min(1.0, 4.0 * per_lang / max(1, n))) for lang, n in counts], "lang string, __part double")
    place = F.abs(F.col("h") / float(1 << 63))
    near = labelled.join(F.broadcast(parts), "lang").where(place <= F.col("__part")).select("lang", "h").distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h"))
    chosen = near.withColumn("__n", nth).where(F.col("__n") <= per_lang).select("lang", "h")  # at most per_lang rows for each language
    wanted = labelled.join(F.broadcast(chosen), ["lang", "h"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            found = []
            for lang, text, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, h) not in seen and has_letter(text):
                    seen.add((lang, h))
                    found.append((lang, h, *(x.tobytes() for x in features(text))))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.binary(), pa.binary()))], names=["lang", "h", "idx", "n"])

    each = wanted.select("lang", "text", "h").mapInArrow(run, "lang string, h long, idx binary, n binary")
    got = each.groupBy("lang", "h").agg(F.min(F.struct("idx", "n")).alias("x")).select("lang", "x.idx", "x.n").collect()
    samples = [(r[0], np.frombuffer(r[1], np.int32), np.frombuffer(r[2], np.float32)) for r in got]
    return Model(sorted(samples, key=lambda s: (s[0], s[1].tobytes(), s[2].tobytes())))


def identify(docs: DataFrame, model: Model, columns: list[Column | str]) -> DataFrame:
    """The given columns of docs with lang_pred and score, which replace columns of these names. Only the text is looked at."""
    named = docs.select(*columns).columns
    kept = [c for c, n in zip(columns, named, strict=True) if n not in ("lang_pred", "score")]
    source = docs.select(*kept, F.col("text").alias("__text"))
    schema = source.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIM numbers for each family and pair of languages in one

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            labels, scores = [], []
            for i, j in pieces(texts, 1 << 20):
                a, b = shared.value.predict(texts[i:j])
                labels += a
                scores += b
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that have no language: null texts, texts without a letter, texts that score below least."""
    inner = docs.columns
    named = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(inner)])
    found = identify(named.withColumn("text", F.col(f"c{inner.index('text')}")), model, [f"c{k}" for k in range(len(inner))])
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(inner)])


def learned_from(docs: DataFrame) -> Model:
    """The contract's model: rows whose crc32(doc_id) mod 4 is 2 are held out."""
    return train(docs, ~held_out(F.col("doc_id"), 4, 2))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null texts, texts without a letter and, where nothing can be learned, all texts are `und` with score 0."""
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 4, 2).alias("held_out")
    return identify(docs, learned_from(docs), ["doc_id", out])
