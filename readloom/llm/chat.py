"""Chat formatting from reply trees.

A message names its parent. Iterated self-joins double the reach of each message's
link to its ancestors, so the messages of every root-to-leaf path are found in as
many joins as the depth has binary digits. The paths of a tree are ranked by the sum
of their messages' scores, ties to the smaller leaf; the best `branches` are written.

The template marks turns as <|im_start|>role\\n text <|im_end|>\\n. Inside texts and
roles a backslash is doubled and <| becomes <\\|, so no text can end or open a turn,
and dropping each first backslash gives the text back; a line break in a role
becomes \\n. The loss mask lists the spans of assistant texts in the written text.

A conversation is written as parts of whole turns, about PART characters each, and
read back part after part, so its length is not bounded by memory.

Defined results: a null text or role is empty; a message whose parent is null or
missing is a root; messages on a cycle are on no path; turns with equal place are
ordered by role and text; rows that repeat are turns of their own; a null
conversation id is a conversation of its own; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.llm.common import same, stash, unstash

START, END = "<|im_start|>", "<|im_end|>\n"
PART = 1 << 20


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """(formatted turn, begin and end of the text in it)."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def read_turns(formatted: str):
    """(role, text) of each turn."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("no turn starts here")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        yield unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end])
        at = end + len(END)


def paths(messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent", score: str | None = None, branches: int = 1) -> DataFrame:
    """(tree, leaf, node, depth): the messages of the chosen root-to-leaf paths, root at depth 0."""
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent"), value.alias("score"))
    known = rows.select(F.col("tree").alias("t"), F.col("node").alias("n")).distinct()
    up = rows.join(known, F.col("tree").eqNullSafe(F.col("t")) & (F.col("parent") == F.col("n")), "left")
    jump = stash(up.select("tree", "node", F.col("n").alias("above"), "score"), "jump")
    roots = jump.where("above IS NULL").select("tree", "node")
    scores = jump.select("tree", "node", "score")
    used = jump.where("above IS NOT NULL").select("tree", F.col("above").alias("node")).distinct()
    leaves = jump.select("tree", "node").alias("a").join(used.alias("b"), same("a", "b", "tree", "node"), "left_anti")
    member = stash(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("above_leaf")), "member")
    reach, most = 1, jump.count()
    jump = jump.select("tree", "node", "above").where("above IS NOT NULL")
    while reach <= most and not jump.isEmpty():
        more = member.alias("m").join(jump.alias("j"), same("m", "j", "tree", "node")).select("m.tree", "m.leaf", F.col("j.above").alias("node"), (F.col("m.above_leaf") + reach).alias("above_leaf"))
        after = stash(member.union(more), "member")
        unstash(member)
        member = after
        on = F.col("a.tree").eqNullSafe(F.col("b.tree")) & (F.col("a.above") == F.col("b.node"))
        longer = stash(jump.alias("a").join(jump.alias("b"), on).select("a.tree", "a.node", "b.above"), "jump")
        jump, reach = longer, 2 * reach
    rooted = member.alias("m").join(roots.alias("r"), same("m", "r", "tree", "node")).select("m.tree", "m.leaf", F.col("m.above_leaf").alias("length"))
    rated = member.alias("m").join(scores.alias("s"), same("m", "s", "tree", "node")).select("m.tree", "m.leaf", "s.score")
    total = rated.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    ranked = rooted.alias("p").join(total.alias("t"), same("p", "t", "tree", "leaf")).select("p.tree", "p.leaf", "p.length", "t.score")
    best = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf"))).where(F.col("rank") <= branches)
    return member.alias("m").join(best.alias("b"), same("m", "b", "tree", "leaf")).select("m.tree", "m.leaf", "m.node", (F.col("b.length") - F.col("m.above_leaf")).alias("depth"))


def format_paths(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Parts (conv_id, leaf, part, text, mask) of the turns (conv_id, leaf, depth, role, text); mask: begin and end pairs in the part."""

    def run(batches):
        key, part, texts, mask, size = None, 0, [], [], 0

        def flush():
            return pa.record_batch({"conv_id": pa.array([key[0]], pa.int64()), "leaf": pa.array([key[1]], pa.int64()), "part": pa.array([part], pa.int64()), "text": pa.array(["".join(texts)]), "mask": pa.array([mask], pa.list_(pa.int64()))})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "leaf", "role", "text")]
            for conv, leaf, role, text in zip(*columns):
                if texts and ((conv, leaf) != key or size >= PART):
                    yield flush()
                    part, texts, mask, size = part + 1 if (conv, leaf) == key else 0, [], [], 0
                key = (conv, leaf)
                written, begin, end = write_turn(role or "", text or "")
                if role == loss_role:
                    mask += [size + begin, size + end]
                texts.append(written)
                size += len(written)
        if texts:
            yield flush()

    ordered = turns.repartition("conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", "depth")
    return ordered.select("conv_id", "leaf", "role", "text").mapInArrow(run, "conv_id long, leaf long, part long, text string, mask array<bigint>")


def read_digests(parts: DataFrame) -> DataFrame:
    """One row per written conversation, from its parts alone."""
    names = ["conv_id", "leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, state, out = None, None, []

        def done():
            n, turns, chars, loss, size = state
            return (*key, n, turns.hexdigest(), chars, loss.hexdigest(), size)

        for batch in batches:
            for conv, leaf, text, mask in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "leaf", "text", "mask"))):
                if state is None or (conv, leaf) != key:
                    if state is not None:
                        out.append(done())
                    key, state = (conv, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, words in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{words}\n".encode())
                for begin, end in zip(mask[::2], mask[1::2]):
                    words = unescape(text[begin:end])
                    state[2] += len(words)
                    state[3].update(words.encode())
                state[4] += len(text)
            if out:
                yield table(out)
                out = []
        if state is not None:
            yield table([done()])

    def table(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    ordered = parts.repartition("conv_id", "leaf").sortWithinPartitions("conv_id", "leaf", "part")
    return ordered.mapInArrow(run, "conv_id long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def tree_turns(messages: DataFrame, *, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role", text: str = "text", score: str | None = None, branches: int = 1) -> DataFrame:
    """(conv_id, leaf, depth, role, text): the turns of the chosen paths of every tree; node must be unique in its tree."""
    chosen = paths(messages, tree=tree, node=node, parent=parent, score=score, branches=branches)
    said = messages.select(F.col(tree).alias("tree"), F.col(node).alias("node"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    turns = chosen.alias("p").join(said.alias("s"), same("p", "s", "tree", "node"))
    return turns.select(F.col("p.tree").cast("long").alias("conv_id"), F.col("p.leaf").cast("long").alias("leaf"), "p.depth", "s.role", "s.text")


def format_trees(messages: DataFrame, **options) -> DataFrame:
    """The written parts of the chosen paths of every tree."""
    return format_paths(tree_turns(messages, **options))


def conversation_messages(conversations: DataFrame) -> DataFrame:
    """Rows by turn as trees of one path: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").withColumn("node", F.row_number().over(order).cast("long"))
    return rows.select(F.col("conv_id").alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text")


def chat_query(conversations: DataFrame) -> DataFrame:
    """One row per conversation, and one for the added conversation -1, also where the table has a -1 itself."""
    said = "<|im_end|><|im_start|>assistant ok"
    # A leaf below all node numbers keeps the added conversation apart.
    extra = conversations.sparkSession.createDataFrame([(-1, -1, 0, "user", said), (-1, -1, 1, "assistant", said)], "conv_id long, leaf long, depth long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    messages = stash(conversation_messages(rows), "messages")
    return read_digests(stash(format_paths(tree_turns(messages).unionByName(extra)), "chat")).drop("leaf")


SQL = r"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, 0 AS own FROM conversations
  UNION ALL SELECT -1, t, r, '<|im_end|><|im_start|>assistant ok', 1 FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(t, r)),
e AS (SELECT *, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS r, replace(replace(text, '\', '\\'), '<|', '<\|') AS x FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|im_start|>') + length(r) + 1 + length(x) + length('<|im_end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, own
"""
