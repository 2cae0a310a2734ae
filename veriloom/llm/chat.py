"""Reply trees as conversations: paths by iterated self-joins, ranked branches, a reversible template with a loss mask."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, stored

# The template of a turn. A backslash keeps the character after it from being read as part of the template.
OPEN, CLOSE, LEARNED = "### ", "</turn>\n", "assistant"
_CONTROL = re.compile(r"\\|#{3,}|</turn>|:")
_TEXT_CONTROL = re.compile(r"\\|#{3,}|</turn>")
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def _guard(m: re.Match) -> str:
    found = m.group()
    return "\\#" * len(found) if found[0] == "#" else "\\" + found


def escape(text: str, control: re.Pattern = _TEXT_CONTROL) -> str:
    """``text`` with backslashes before backslashes, runs of three or more # and end marks."""
    return control.sub(_guard, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turns(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the assistant texts in it, in code points, end exclusive."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"{OPEN}{escape(role or '', _CONTROL)}: "
        body = escape(text or "")
        parts += [head, body, CLOSE]
        if role == LEARNED:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of a formatted conversation."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(found.group(1)), unescape(found.group(2))))
        at = found.end()
    return out


def _doubled(messages: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Ancestors by doubling: (jumps, sums, endless).

    The n-th jump table has (node, up) for every message with an ancestor 2^n
    replies above; sums has (node, depth, total), the messages from the root to
    each message and their scores. A message leaves the joins once its path is
    known. No path has more messages than the table, so those that still have
    an ancestor beyond that lead to a cycle: endless.
    """
    parents = messages.select(F.col("message_id").alias("up"), F.lit(True).alias("known"))
    start = stored(messages.select(F.col("message_id").alias("node"), F.col("parent_id").alias("up"), F.lit(1).cast("long").alias("depth"),
                                   F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"))
                   .join(parents, "up", "left").withColumn("up", F.when(F.col("known"), F.col("up"))).drop("known"), "replies")
    open_, done = start.where("up is not null"), start.where("up is null")
    jumps, longest = [], messages.count()
    while not open_.isEmpty() and 2 ** len(jumps) <= longest:
        jumps.append(open_.select("node", "up"))
        above = open_.unionByName(done).select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("total").alias("extra"))
        step = stored(open_.join(above, "up").select("node", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"),
                                                     (F.col("total") + F.col("extra")).alias("total")), "replies")
        open_, done = step.where("up is not null"), done.unionByName(step.where("up is null"))
    return jumps, done.drop("up"), open_.select(F.col("node").alias("message_id"))


def branches(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf, branch, branch_score, depth, message_id, role, text): the messages of every chosen root-to-leaf path.

    ``messages`` has tree_id, message_id (unique), parent_id, role, text and
    score. The branches of a tree are numbered by descending mean score, ties by
    leaf; with ``best`` only that many of each tree are chosen. Messages whose
    parent is unknown are roots; a null score counts as 0; messages on a cycle
    of parents belong to no path. The joins double the length of the known part of a path, so their
    number is the logarithm of the longest one, and carry ids, not texts.
    """
    jumps, sums, endless = _doubled(messages)
    if not endless.isEmpty():
        return branches(messages.join(endless, "message_id", "left_anti"), best)
    has_reply = messages.select(F.col("parent_id").alias("message_id")).where("message_id is not null").distinct()
    leaves = messages.select("tree_id", "message_id").join(has_reply, "message_id", "left_anti")
    order = W.partitionBy("tree_id").orderBy(F.desc("branch_score"), "leaf")
    ranked = (leaves.join(sums.withColumnRenamed("node", "message_id"), "message_id")
              .select("tree_id", F.col("message_id").alias("leaf"), (F.col("total") / F.col("depth")).alias("branch_score"))
              .withColumn("branch", F.row_number().over(order)))
    chosen = stored(ranked if best is None else ranked.where(F.col("branch") <= best), "leaves")
    on_path = chosen.select("leaf", F.col("leaf").alias("node"))
    for step in reversed(jumps):
        on_path = stored(on_path.union(on_path.join(step, "node").select("leaf", F.col("up").alias("node"))), "paths")
    return (on_path.join(chosen, "leaf").join(sums.select("node", "depth"), "node").withColumnRenamed("node", "message_id")
            .join(messages.select("message_id", "role", "text"), "message_id")
            .select("tree_id", "leaf", "branch", "branch_score", "depth", "message_id", "role", "text"))


def _format_batches(batches):
    for batch in batches:
        formatted, loss = [], []
        for turns in batch.column(4).to_pylist():
            text, spans = format_turns([(t["role"], t["text"]) for t in turns])
            formatted.append(text)
            loss.append([{"from": a, "to": b} for a, b in spans])
        span = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(formatted, pa.string()), pa.array(loss, span)],
                                         names=["tree_id", "leaf", "branch", "branch_score", "formatted", "loss"])


def conversations(messages: DataFrame, best: int | None = None) -> DataFrame:
    """(tree_id, leaf, branch, branch_score, formatted, loss): one row per chosen path of ``branches``.

    ``loss`` holds the spans of ``formatted`` a model learns from: the assistant
    texts. Null roles and texts count as empty. An empty table gives an empty
    table; further columns are ignored.
    """
    bound_batches(messages.sparkSession)
    turns = F.transform(F.array_sort(F.collect_list(F.struct("depth", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    kind = dict(messages.dtypes)
    return (branches(messages, best).groupBy("tree_id", "leaf", "branch", "branch_score").agg(turns.alias("turns"))
            .mapInArrow(_format_batches, f"tree_id {kind['tree_id']}, leaf {kind['message_id']}, branch int, branch_score double, "
                                         "formatted string, loss array<struct<from: int, to: int>>"))


def chain(turns: DataFrame) -> DataFrame:
    """Messages of tables that hold each conversation as rows (conv_id, turn, role, text): each turn replies to the one before.

    Turns of one number, also repeated rows, follow each other by role and text.
    Rows without a conv_id are one conversation. The numbered turns are written
    once; what follows reads the ids of that table, and the texts at the end.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = stored(turns.select("conv_id", "role", "text", F.row_number().over(order).alias("n")), "turns")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("none")), F.lit(":"))
    return numbered.select(F.col("conv_id").alias("tree_id"), F.concat(name, F.col("n").cast("string")).alias("message_id"),
                           F.when(F.col("n") > 1, F.concat(name, (F.col("n") - 1).cast("string"))).alias("parent_id"),
                           "role", "text", F.lit(0.0).alias("score"))
