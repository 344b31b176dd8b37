"""Reply trees formatted as conversations.

Nodes (tree, node, parent, score) form trees. Self-joins double each node's jump towards its root, so paths of any length take
log2(depth) joins; with the jumps go the path's score and length. In each tree the leaf with the best mean score is chosen (ties:
the longer path, then the smaller node), the jumps mark the nodes on its path, and that path becomes one conversation.

Template: each turn is `### Role: text</turn>` and a line break. In texts a backslash becomes two, `##` becomes `#\\#` and `</turn>`
becomes `<\\/turn>`, so that no control string can occur inside a text; a backslash and a character read back as the character.
The roles user, assistant and system are written with a capital; any other begins with a backslash (one is put before it unless its escaped form has one), with its colons escaped;
an empty or null role is written as nothing.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import materialize, table

ROLES = {"user": "User", "assistant": "Assistant", "system": "System", "": ""}
BACK = {v: k for k, v in ROLES.items()}
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:(?!</turn>).)*)</turn>\n", re.S)
LEARNED = "assistant"
#: The contract's extra conversation.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("##", "#\\#").replace("</turn>", "<\\/turn>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _mark(role: str) -> str:
    if role in ROLES:
        return ROLES[role]
    escaped = escape(role).replace(":", "\\:")
    return escaped if escaped.startswith("\\") else "\\" + escaped


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask: the spans (code points, ends exclusive) of the assistant's texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + _mark(role) + MIDDLE, escape(text)
        parts += [head, body, CLOSE]
        if role == LEARNED:
            mask.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    return [(BACK[m[1]] if m[1] in BACK else unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def learned(formatted: str, mask: list[tuple[int, int]]) -> str:
    """All text under the loss mask, unescaped."""
    return "".join(unescape(formatted[s:e]) for s, e in mask)


def best_paths(nodes: DataFrame) -> DataFrame:
    """nodes (tree, node, parent, score; (tree, node) unique): rows (tree, node, depth) of the best path of each tree.

    A node whose parent is null or missing is a root. Null trees are one tree, null scores count 0. Parents that form a circle
    raise ValueError.
    """
    nodes = nodes.select("tree", "node", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    ids = nodes.select(F.col("tree").alias("t"), F.col("node").alias("p"))
    known = nodes.join(ids, nodes["tree"].eqNullSafe(F.col("t")) & (nodes["parent"] == F.col("p")), "left")
    jump = materialize(known.select("tree", "node", F.col("p").alias("up"), "score", F.lit(1).cast("long").alias("depth")), "jump")
    first, levels = jump, []
    while True:
        levels.append(jump.where("up is not null").select("tree", "node", "up"))
        if levels[-1].isEmpty():
            break
        if len(levels) > 62:
            raise ValueError("the replies form a circle")
        above = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("depth").alias("depth2"))
        open_ = jump.where("up is not null")  # what has reached its root isn't joined again
        both = open_.join(above, open_["tree"].eqNullSafe(F.col("t")) & (open_["up"] == F.col("n")))
        moved = both.select("tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("depth") + F.col("depth2")).alias("depth"))
        jump = materialize(jump.where("up is null").unionByName(moved), "jump")
    inner = first.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("p")).distinct()
    leaves = jump.join(inner, jump["tree"].eqNullSafe(F.col("t")) & (jump["node"] == F.col("p")), "left_anti")
    best = leaves.groupBy("tree").agg(F.max(F.struct((F.col("score") / F.col("depth")).alias("mean"), F.col("depth").alias("long"), (-F.col("node")).alias("low"))).alias("b"))
    path = best.select("tree", (-F.col("b.low")).alias("node"))
    for level in reversed(levels[:-1]):  # each jump halves the gaps of what is marked
        up = level.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        path = materialize(path.unionByName(path.join(up, path["tree"].eqNullSafe(F.col("t")) & (path["node"] == F.col("n"))).select("tree", F.col("up").alias("node"))), "path")
    depth = jump.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return path.join(depth, path["tree"].eqNullSafe(F.col("t")) & (path["node"] == F.col("n"))).select("tree", "node", "depth")


def format_trees(messages: DataFrame) -> DataFrame:
    """messages (tree, node, parent, score, role, text): a conversation for each tree as (tree, formatted, loss array of (start, end))."""
    path = best_paths(messages)
    m = messages.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = path.join(m, path["tree"].eqNullSafe(F.col("t")) & (path["node"] == F.col("n")))
    gathered = turns.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))  # one conversation is one row of the output

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in f["turns"]]
            yield pd.DataFrame({"tree": f["tree"], "formatted": [x for x, _ in made], "loss": [[{"start": s, "end": e} for s, e in mask] for _, mask in made]})

    kind = gathered.schema["tree"].dataType.simpleString()
    return gathered.mapInPandas(run, f"tree {kind}, formatted string, loss array<struct<start:long,end:long>>")


def conversation_trees(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) as trees: each row replies to the one before it by turn (null first; ties by role, then text)."""
    nth = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select(F.col("conv_id").cast("long").alias("tree"), nth.alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(0.0).alias("score"), "role", "text")


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader of the formatted conversations gets, as digests."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for text, mask in zip(f["formatted"], f["loss"], strict=True):
                turns = parse(text)
                under = learned(text, [(int(m["start"]), int(m["end"])) for m in mask])
                said = "".join(f"{r}\n{t}\n" for r, t in turns)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(under), hashlib.sha256(under.encode()).hexdigest(), len(text)))
            out = pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            out.insert(0, "conv_id", f["tree"].to_numpy())
            yield out

    return formatted.mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], rows.schema)
    trees = materialize(conversation_trees(rows.unionByName(probe)), "trees")
    return read_back(format_trees(trees))


SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(14 + length(CASE WHEN role IN ('user', 'assistant', 'system') OR role = '' THEN role
       ELSE CASE WHEN left(role, 1) IN ('\', ':') THEN '' ELSE '\' END || replace(replace(replace(replace(role, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'), ':', '\:') END)
    + length(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '</turn>', '<\/turn>'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
