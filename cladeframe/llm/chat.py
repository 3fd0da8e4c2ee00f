"""Chat formatting as a prefix tree.

Conversations that share their first turns share tree nodes; a node is a turn after a given history. Nodes are emitted
once, in depth-first order: conversations are range-sorted by their paths of node keys, and a node belongs to the first
conversation that has it; (that conversation's rank, depth) is the order of nodes. Each node carries its
place in the emitted stream of tokens, the position id of its first token (tokens of its ancestors), and the stream
intervals of its ancestors, which are all that its tokens may attend to besides the node itself.

The template marks a turn as <|im_start|>role, newline, text, <|im_end|>, newline. In texts and roles a backslash is
doubled, and one is set after the first character of a control string (or of what would read as an escape), so no
control string is left in them and reading back is exact; a newline in a role is written as backslash, n.

Cases: turns are ordered by turn (null first), role, text; a null text or role is empty; a row with a null id
belongs to no other and is a conversation of its own; repeated rows are turns of their own; a long conversation is one row, as it is one training example; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.materialize import materialize
from .common import spread_join

START, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPE = re.compile(r"\\|[<\[](?=\\|\||/?s>|/?INST\]|</?SYS>>)")
_UNESCAPE = re.compile(r"\\\\|([<\[])\\")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[1] or "\\", text)


def role_in(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def role_out(role: str) -> str:
    return re.sub(r"\\\\|\\n|([<\[])\\", lambda m: "\n" if m[0] == "\\n" else m[1] or "\\", role)


def turn_rows(conversations: DataFrame) -> DataFrame:
    """One row per turn: conv (a number of the conversation), conv_id, depth, node, path, segment (the formatted turn),
    loss_at, loss_len.

    node is the 128-bit digest of the turns so far; the last turn carries the path, 8 bytes of each digest on the way.
    """
    turn = F.struct(F.col("turn").cast("long").alias("t"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = conversations.select(F.col("conv_id").cast("long"), turn.alias("x"))
    whole = own.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    whole = whole.unionByName(own.where("conv_id is null").select("conv_id", F.array("x").alias("turns")))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv", "conv_id", "depth", "node", "path", "segment", "loss_at", "loss_len"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32()]
        conv = TaskContext.get().partitionId() << 33
        for b in batches:
            for conv_id, turns in zip(b.column(0).to_pylist(), b.column(1)):
                rows, node, path, turns = [], b"", b"", turns.as_py()
                for depth, x in enumerate(turns):
                    role, body = role_in(x["role"]), escape(x["text"])
                    node = hashlib.blake2b(node + len(role.encode()).to_bytes(8, "big") + role.encode() + body.encode(), digest_size=16).digest()
                    path += node[:8]
                    head = f"{START}{role}\n"
                    loss = len(body) if x["role"] == "assistant" else 0
                    rows.append((conv, conv_id, depth, node, path if depth == len(turns) - 1 else None, head + body + END, len(head), loss))
                conv += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return whole.mapInArrow(walk, "conv long, conv_id long, depth int, node binary, path binary, segment string, loss_at int, loss_len int")


def emit(turns: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """The stream: node, segment, loss_at, loss_len, ids (binary, 32 bits each), n_ids, starts (first token's place), and
    n_, how many conversations have the node."""
    leaves = turns.where("path is not null").select("conv", "path").repartitionByRange("path", "conv").sortWithinPartitions("path", "conv")
    ranks = materialize(leaves.select("conv", F.monotonically_increasing_id().alias("rank")), "ranks")
    # A conversation's turns are joined with one row: no key is hot.
    firsts = turns.select("conv", "node").join(ranks, "conv").groupBy("node").agg(F.min("rank").alias("rank"), F.count("*").alias("n_"))
    nodes = turns.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("depth", "segment", "loss_at", "loss_len")]).join(firsts, "node")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from cladeframe.llm.packing import _tokenizer

        tok = _tokenizer(tokenizer)
        tok.encode_special_tokens = True
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # encodings are many times the size of their text
                b = batch.slice(lo, 64)
                # The body is encoded apart from its marks, so that the loss mask falls between tokens.
                parts = []
                for text, at in zip(b.column("segment").to_pylist(), b.column("loss_at").to_pylist()):
                    parts += [text[:at], text[at : -len(END)], END]
                found = [tok.encode(p, add_special_tokens=False).ids for p in parts]
                ids = [np.array(found[k] + found[k + 1] + found[k + 2], "<u4").tobytes() for k in range(0, len(found), 3)]
                b = b.append_column("ids", pa.array(ids, pa.binary()))
                yield b.append_column("n_ids", pa.array([len(x) // 4 for x in ids], pa.int64()))

    # Sorted first: the range sort reads its input twice, and encoding keeps the rows' order.
    ranged = nodes.repartitionByRange("rank", "depth").sortWithinPartitions("rank", "depth")
    ranged = ranged.mapInArrow(encode, "node binary, depth int, segment string, loss_at int, loss_len int, rank long, n_ long, ids binary, n_ids long")
    ranged = materialize(ranged.select("*", F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_m")), "tree")
    sums, before, starts = {r["_p"]: r["n"] for r in ranged.groupBy("_p").agg(F.sum("n_ids").alias("n")).collect()}, 0, []
    for p in sorted(sums):  # a number per partition
        starts.append((p, before))
        before += sums[p]
    at = ranged.sparkSession.createDataFrame(starts, "_p int, _start long")
    run = F.sum("n_ids").over(Window.partitionBy("_p").orderBy("_m").rowsBetween(Window.unboundedPreceding, 0))
    placed = ranged.withColumn("_run", run).join(F.broadcast(at), "_p")
    return placed.select("node", "segment", "loss_at", "loss_len", "ids", "n_ids", "n_", (F.col("_start") + F.col("_run") - F.col("n_ids")).alias("starts"))


def conversations_of(turns: DataFrame, stream: DataFrame) -> DataFrame:
    """Per conversation its nodes of the stream, in order: conv_id, nodes."""
    columns = ["starts", "n_ids", "loss_at", "loss_len", "segment", "position", "n_intervals", "mask"]
    columns = [c for c in columns if c in stream.columns]
    found = spread_join(turns.select("conv", "conv_id", "depth", "node"), stream.select("node", "n_", *columns), ["node"], F.col("conv"))
    return found.groupBy("conv", "conv_id").agg(F.array_sort(F.collect_list(F.struct("depth", "node", *columns))).alias("nodes")).drop("conv")


def attention(read: DataFrame) -> DataFrame:
    """Per node: node, starts, n_ids, position (id of its first token), ancestors (intervals of the stream, merged)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for nodes in b.column(0):
                rows, spans, position = [], [], 0
                for x in nodes.as_py():
                    rows.append((x["node"], x["starts"], x["n_ids"], position, list(spans)))
                    if spans and spans[-1]["end"] == x["starts"]:
                        spans[-1] = {"start": spans[-1]["start"], "end": x["starts"] + x["n_ids"]}
                    else:
                        spans.append({"start": x["starts"], "end": x["starts"] + x["n_ids"]})
                    position += x["n_ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.int64(), span))], names=["node", "starts", "n_ids", "position", "ancestors"])

    rows = read.select("nodes").mapInArrow(run, "node binary, starts long, n_ids long, position long, ancestors array<struct<start:long,end:long>>")
    return rows.groupBy("node").agg(*[F.any_value(c).alias(c) for c in ("starts", "n_ids", "position", "ancestors")])


def masked(turns: DataFrame, stream: DataFrame) -> DataFrame:
    """The stream with each node's position, number of ancestor intervals, and mask: the SHA-256 of "start:end" of these
    intervals, joined by commas."""
    seen = attention(conversations_of(turns, stream.select("node", "n_", "starts", "n_ids")))
    said = F.transform("ancestors", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string")))
    mask = seen.select("node", "position", F.size("ancestors").cast("long").alias("n_intervals"), F.sha2(F.array_join(said, ","), 256).alias("mask"))
    return stream.join(mask, "node")


def read_back(read: DataFrame) -> DataFrame:
    """What the formatted text of each conversation says: the contract's digests; and its masks: nodes, position ids
    (the next one after its last token), intervals attended to, and the digest of "position:length:mask" lines."""
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64(), "n_ids": pa.int64()}
    kinds |= {"n_nodes": pa.int64(), "next_position": pa.int64(), "n_intervals": pa.int64(), "attention_sha256": pa.string()}

    def masks_of(nodes: list[dict]) -> tuple[int, int, int, str]:
        lines = "".join(f"{x['position']}:{x['n_ids']}:{x['mask']}\n" for x in nodes)
        return len(nodes), nodes[-1]["position"] + nodes[-1]["n_ids"], sum(x["n_intervals"] for x in nodes), hashlib.sha256(lines.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv_id, nodes in zip(b.column(0).to_pylist(), b.column(1)):
                nodes = nodes.as_py()
                text, mask = "", []
                text = "".join(x["segment"] for x in nodes)
                at = 0
                for x in nodes:
                    mask += [(at + x["loss_at"], at + x["loss_at"] + x["loss_len"])] * (x["loss_len"] > 0)
                    at += len(x["segment"])
                turns = [(role_out(m[1]), unescape(m[2])) for m in _TURN.finditer(text)]
                digest = hashlib.sha256()
                for role, said in turns:
                    digest.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[a:e]) for a, e in mask)
                rows.append((conv_id, len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), sum(x["n_ids"] for x in nodes), *masks_of(nodes)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds.values())], names=list(kinds))

    return read.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, n_nodes long, next_position long, n_intervals long, attention_sha256 string")


def format_conversations(conversations: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> tuple[DataFrame, DataFrame]:
    """(stream, per-conversation nodes): see emit and conversations_of; attention() of the second gives the masks."""
    turns = materialize(turn_rows(conversations), "turns")
    stream = materialize(emit(turns, tokenizer), "stream")
    return stream, conversations_of(turns, stream)


def chat_report(conversations: DataFrame) -> DataFrame:
    """The contract's columns per conversation, and its nodes' position ids and attention: see read_back."""
    turns = materialize(turn_rows(conversations), "turns")
    stream = materialize(emit(turns), "stream")
    return read_back(conversations_of(turns, masked(turns, stream)))
