"""Chat formatting over a prefix tree: shared initial turns are emitted once, depth first.

A node is a turn together with all turns before it; its name is a hash chained over roles and texts. A conversation's turns are a path, and
the smallest conversation on a node owns it. Owners only grow along a path, so a conversation owns one unbroken end of its path: a
chain. Chains in the order of their branching points (deeper branches first, then smaller owners) are the depth-first order of
each tree, whose stream of tokens (code points of the formatted text) is laid out by sums over ranges of chains; no tree has to fit a task.

Each node of the output has its place in the stream, the position id of its first token (tokens before it on its path), the
intervals of the stream that its tokens attend to besides themselves (its ancestors), and the interval under the loss mask. A path's
ancestors make one interval per branching point, not one per turn.

The template writes ``### role: text</turn>`` and a line break. A backslash goes before each backslash, ``###`` and ``</turn>`` of a text
(in roles also before a colon), so control strings appear unescaped only where the template puts them.

Defined results: turns are ordered by turn, then role, then text, null turns first, and equal rows stay separate turns; null roles and
texts are empty; rows without a conversation are left out; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyflow.llm.rendezvous import shared_folder

START, COLON, END = "### ", ": ", "</turn>\n"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_SEGMENT = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): (.*)</turn>\n", re.DOTALL)
ROOT = bytes(16)
_TURNS = "conv_id long, depth int, node binary, parent binary, role string, segment string, chars long, position long, loss_from long, loss_to long"
_TURNS_SCHEMA = pa.schema([
    ("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()), ("role", pa.string()), ("segment", pa.string()),
    ("chars", pa.int64()), ("position", pa.int64()), ("loss_from", pa.int64()), ("loss_to", pa.int64()),
])


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text begins and ends in it."""
    head = START + _ROLE.sub(r"\\\g<0>", role) + COLON
    body = _TEXT.sub(r"\\\g<0>", text)
    return head + body + END, len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    found = _SEGMENT.fullmatch(segment)
    if not found:
        raise ValueError("not a formatted turn")
    return unescape(found[1]), unescape(found[2])


def _chain(loss_role: str):
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes along each conversation; rows come ordered."""
        conv, depth, node, position = None, 0, ROOT, 0
        for batch in batches:
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv:
                    conv, depth, node, position = conv_id, 0, ROOT, 0
                segment, a, b = format_turn(role, text)
                parent, name = node, hashlib.blake2b(node, digest_size=16)
                name.update(segment.encode())
                node = name.digest()
                loss = (a, b) if role == loss_role else (None, None)
                out.append((conv, depth, node, parent, role, segment, len(segment), position, *loss))
                depth, position = depth + 1, position + len(segment)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _TURNS_SCHEMA, strict=True)] if out else [pa.array([], f.type) for f in _TURNS_SCHEMA], schema=_TURNS_SCHEMA)

    return chain


def chat_tree(conversations: DataFrame, loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """The packed output and the paths through it.

    Packed, a row per node: tree, start, end (place in the tree's stream), position (id of the first token), attends (intervals of
    the stream that its tokens see besides those of the node up to themselves), segment, loss_start, loss_end (interval of the stream
    under the loss mask, null if none), node, parent, depth, owner. Paths: conv_id, depth, node.
    """
    shared_folder(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    turns = ordered.mapInArrow(_chain(loss_role), _TURNS).checkpoint()
    paths = turns.select("conv_id", "depth", "node")
    owners = turns.groupBy("node").agg(F.min("conv_id").alias("owner"))
    # a row per conversation and owner on its path: where the owner's part begins
    parts = turns.select("conv_id", "node", "depth", "position").join(owners, "node").groupBy("conv_id", "owner").agg(F.min("depth").alias("depth"), F.min("position").alias("position"))
    lengths = turns.groupBy("conv_id").agg(F.sum("chars").alias("all_chars"))
    key = F.array_sort(F.collect_list(F.struct("depth", "owner", "position")))
    chains = (
        parts.groupBy("conv_id").agg(key.alias("key")).join(lengths, "conv_id")
        .where(F.element_at("key", -1)["owner"] == F.col("conv_id"))
        .select("conv_id", "key", F.col("key")[0]["owner"].alias("tree"), F.transform("key", lambda x: F.struct((-x["depth"]).alias("d"), x["owner"].alias("o"))).alias("place"),
                (F.col("all_chars") - F.element_at("key", -1)["position"]).alias("chars"))
        .repartitionByRange("tree", "place").checkpoint()  # so that the ranges stay as they are
    ).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = chains.groupBy("tree", "part").agg(F.sum("chars").alias("sum")).select("tree", "part", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("tree", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    laid = (
        chains.withColumn("inner", F.coalesce(F.sum("chars").over(within), F.lit(0))).join(bases, ["tree", "part"])
        .select("conv_id", "tree", "key", (F.col("base") + F.col("inner")).alias("chain_start")).checkpoint()
    )
    # what a chain sees of the chains it hangs from: from their start up to the next branching point
    seen = laid.select("conv_id", F.posexplode("key").alias("i", "k"), F.col("key")).where("i < size(key) - 1")
    seen = seen.select("conv_id", F.col("k.owner").alias("owner"), F.expr("key[i + 1].position - k.position").alias("length"))
    starts = laid.select(F.col("conv_id").alias("owner"), F.col("chain_start").alias("from"))
    seen = seen.join(starts, "owner").groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("from").alias("start"), (F.col("from") + F.col("length")).alias("end")))).alias("above")
    )
    chain = laid.join(seen, "conv_id", "left").select("conv_id", "tree", "chain_start", "above", F.element_at("key", -1)["depth"].alias("own_from"), F.element_at("key", -1)["position"].alias("own_position"))
    none = F.expr("CAST(array() AS array<struct<start: bigint, end: bigint>>)")
    start = F.col("chain_start") + F.col("position") - F.col("own_position")
    own = F.when(F.col("start") > F.col("chain_start"), F.array(F.struct(F.col("chain_start").alias("start"), F.col("start").alias("end")))).otherwise(none)
    packed = (
        turns.join(chain, "conv_id").where("depth >= own_from").withColumn("start", start)
        .select("tree", "start", (F.col("start") + F.col("chars")).alias("end"), "position", F.concat(F.coalesce("above", none), own).alias("attends"), "segment",
                (F.col("start") + F.col("loss_from")).alias("loss_start"), (F.col("start") + F.col("loss_to")).alias("loss_end"),
                "node", "parent", "depth", F.col("conv_id").alias("owner"))
    )
    return packed, paths


_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, state = None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def done() -> tuple:
        n, turns, loss_chars, loss, chars = state
        return conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars

    out = []
    for batch in batches:
        for conv_id, segment, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "a", "b")), strict=True):
            if conv_id != conv:
                if state:
                    out.append(done())
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(segment)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if a is not None:
                masked = unescape(segment[a:b])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(segment)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=names)
            out = []
    if state:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(done(), strict=True)], names=names)


def read_back(packed: DataFrame, paths: DataFrame) -> DataFrame:
    """Digests of every conversation as the packed output has it: its turns, and the text under the loss mask."""
    nodes = packed.select("node", "segment", (F.col("loss_start") - F.col("start")).cast("int").alias("a"), (F.col("loss_end") - F.col("start")).cast("int").alias("b"))
    rows = paths.join(nodes, "node").repartition("conv_id").sortWithinPartitions("conv_id", "depth")
    return rows.select("conv_id", "segment", "a", "b").mapInArrow(_digests, _DIGEST)
