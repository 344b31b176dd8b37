"""License scan: phrases, and an exact set-similarity join of text blocks with license templates, in DataFrame functions only.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased. For a template of n words, blocks are 2 n words, one
every n words, so that any passage of up to n words lies whole in one. A block meets a template if it holds at least CONTAINED of its
distinct tokens. The templates' tokens are ordered by the number of documents that hold them over the whole corpus, rarest first. A
block can only meet a template of t tokens, c of them needed, if it holds one of the template's t - c + 1 rarest (prefix filter),
holds at least c tokens of templates of its length (length filter), and enough tokens follow the shared one in both orders (positional
filter). What passes is counted exactly.

Each text is split into words once. Documents that don't hold c tokens of any template are never cut into blocks; the words of the
others are joined with the token table, and their blocks with the template table by prefix tokens.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import LOWER, UPPER, ascii_lower, materialize, table

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
CONTAINED = 0.8

#: Paragraphs of public licenses and usual statements of them, with their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
]


def _normal(text: Column) -> Column:
    """The words joined and surrounded by spaces. lower() differs from lowering A-Z in words that no phrase or template has, but for
    two letters, whose lower case holds one of a-z.
    """
    text = F.coalesce(text, F.lit(""))
    low = F.when(F.contains(text, F.lit("K")) | F.contains(text, F.lit("İ")), ascii_lower(text)).otherwise(F.lower(text))
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), GAP, " ")


def _words(normal: Column) -> Column:
    bare = F.trim(normal)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, " "))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table made of a literal."""
    made = F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")
    return spark.range(1).select(F.explode(made).alias("r")).select("r.*")


def _starts(phrase: str) -> Column:
    """Indexes at which the phrase's words stand consecutively."""
    parts = phrase.split()
    w = F.col("__w")
    here = F.filter(F.sequence(F.lit(0), F.size(w) - len(parts)), lambda i: _all(F.get(w, i + k) == p for k, p in enumerate(parts)))
    return F.when(F.contains(F.col("__normal"), F.lit(f" {phrase} ")), here).otherwise(F.array().cast("array<int>"))


def _all(parts) -> Column:
    out = None
    for p in parts:
        out = p if out is None else out & p
    return out


def _needed(text: str, contained: float) -> int:
    return math.ceil(contained * len(set(text.split())) - 1e-9)


def token_order(held: DataFrame, vocabulary: list[str]) -> list[str]:
    """The templates' tokens, rarest in the corpus first; held: a column `held` with the tokens of each document. Ties by code point."""
    count = {r[0]: r[1] for r in held.select(F.explode("held").alias("w")).groupBy("w").count().collect()}  # at most a row for each token of the templates
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def join_templates(words: DataFrame, order: list[str], templates: list[tuple[str, str]], contained: float) -> DataFrame:
    """words (rid, words): (rid, label, containment) for each block and template that meet."""
    spark = words.sparkSession
    rank = {w: k for k, w in enumerate(order)}
    spans = sorted({len(t.split()) for _, t in templates})
    tokens = [{"token": w, "span": n, "r": rank[w]} for n in spans for w in sorted({w for _, t in templates if len(t.split()) == n for w in t.split()})]
    prefixes = []
    for label, text in templates:
        own = sorted({rank[w] for w in text.split()})
        need = _needed(text, contained)
        prefixes += [{"span": len(text.split()), "r": r, "label": label, "tokens": own, "need": need, "after": len(own) - k} for k, r in enumerate(own[: len(own) - need + 1])]
    known = _rows(spark, tokens, "token string, span int, r int")  # both tables are of the templates' size
    wanted = _rows(spark, prefixes, "span int, r int, label string, tokens array<int>, need int, after int")
    hits = words.select("rid", F.posexplode("words").alias("at", "token")).join(F.broadcast(known), "token")
    block = F.floor(F.col("at") / F.col("span"))
    placed = hits.select("rid", "span", "r", F.explode(F.array(block, block - 1)).alias("block")).where("block >= 0")
    blocks = placed.groupBy("rid", "span", "block").agg(F.array_sort(F.collect_set("r")).alias("held"))  # of at most 2 * span words
    pairs = blocks.select("*", F.posexplode("held").alias("at", "r")).join(F.broadcast(wanted), ["span", "r"])
    left = F.least(F.col("after"), F.size("held") - F.col("at"))
    passed = pairs.where((F.size("held") >= F.col("need")) & (left + F.size("tokens") - F.col("after") >= F.col("need")))
    shared = F.size(F.array_intersect("held", "tokens"))
    return passed.where(shared >= F.col("need")).select("rid", "label", (shared / F.size("tokens").cast("double")).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """A row for every row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Null and empty texts have no words and no labels, score 0. Repeated rows each get their row; extra columns are ignored; an
    empty table gives an empty result. score: 1 with a base place, else the largest containment among the templates met, else 0.
    Ties between templates don't show: all labels met are returned.
    """
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    rows = docs.select("doc_id", _normal(F.col("text")).alias("__normal")).withColumn("__w", _words(F.col("__normal")))
    rows = rows.withColumn("held", F.array_intersect(_strings(vocabulary), F.col("__w")))
    sets = [F.struct(_strings(sorted(set(t.split()))).alias("tokens"), F.lit(_needed(t, contained)).alias("need")) for _, t in templates]
    maybe = F.exists(F.array(*sets), lambda s: F.size(F.array_intersect(s["tokens"], F.col("held"))) >= s["need"]) if sets else F.lit(False)
    base = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(F.contains(F.col("__normal"), F.lit(f" {p} ")), F.lit(label)) for p, label in PHRASES.items()]))))
    starts = F.array_sort(F.concat(*[_starts(p) for p in PHRASES]))
    lean = rows.withColumn("starts", starts).select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.size("__w").cast("long").alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        base.alias("base"),
        "held",
        F.when(maybe, F.col("__w")).alias("words"),
    )
    lean = materialize(lean, "licenses")
    met = join_templates(lean.where("words IS NOT NULL").select("rid", "words"), token_order(lean, vocabulary), templates, contained)
    found = met.groupBy("rid").agg(F.collect_set("label").alias("own"), F.max("containment").alias("best"))
    every = F.array_join(F.array_sort(F.array_union("base", F.coalesce("own", _strings([])))), ",")
    return lean.drop("words", "held").join(found, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), every.alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same by counting every block against every template."""
    tokens = ", ".join(f"({k}, '{label}', {len(t.split())}, {len(set(t.split()))}, {_needed(t, CONTAINED)}, '{w}')" for k, (label, t) in enumerate(TEMPLATES) for w in sorted(set(t.split())))
    here = [f"list_filter(range(len(w)), lambda i: {' AND '.join(f'w[i + {j + 1}] = {w!r}' for j, w in enumerate(p.split()))})" for p in PHRASES]
    labels = ", ".join(f"CASE WHEN len({h}) > 0 THEN '{label}' END" for h, label in zip(here, PHRASES.values(), strict=True))
    starts = here[0]
    for h in here[1:]:
        starts = f"list_concat({starts}, {h})"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT rid, doc_id, len(w) AS n_words, {starts} AS starts, list_filter([{labels}], lambda x: x IS NOT NULL) AS base FROM d),
tokens(id, label, span, n, need, token) AS (VALUES {tokens}),
words AS (SELECT rid, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos FROM d),
placed AS (SELECT rid, id, label, n, need, token, unnest([pos // span, pos // span - 1]) AS block FROM words JOIN tokens USING (token)),
met AS (SELECT rid, label, count(DISTINCT token) / CAST(n AS DOUBLE) AS c FROM placed WHERE block >= 0 GROUP BY rid, id, label, n, need, block HAVING count(DISTINCT token) >= need),
found AS (SELECT rid, list(DISTINCT label) AS own, max(c) AS best FROM met GROUP BY rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(starts) AS BIGINT) AS n_base, CAST(list_min(starts) AS BIGINT) AS first_word, CAST(list_max(starts) AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(own, [])))), ',') AS labels,
  CASE WHEN len(starts) > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM b LEFT JOIN found USING (rid)
"""


SQL = _sql()
