"""Chat formatting as a prefix tree: conversations that share first turns share their tokens.

A turn's key is a hash chained over all turns before it, so equal keys are equal prefixes, and conversations sorted by
their keys' paths are the leaves of the prefix tree in depth-first order. Going through them, what a conversation has
beyond its predecessor's path is new and is emitted once; the rest is there already. There is one tree for each first turn. The
order is cut into chunks, so that a tree of very many conversations is spread over many tasks: a chunk takes over, as its
spine, the path that the chunk before it ends on, as far as its first leaf shares it, and goes on counting where that stopped.

Tokens are code points, or ids of a tokenizer where one is given. Each node has the position of its first token on its
own path (position ids run from there) and the intervals of earlier tokens that it attends to besides its own. Reading
back uses these alone: a conversation is what its last turn attends to, in order, and that turn.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import join_counted, shared_table, small_batches

# The template. In roles and texts each of \\, # and < gets a backslash before it (in roles : and line ends too),
# so neither mark occurs in them as it stands.
HEAD, MID, END = "### ", ":\n", "\n</turn>\n"
TRAINED_ROLE = "assistant"
KEY = 16
#: An entry of a path: the turn's key and how many tokens it has.
ENTRY = KEY + 8


def escape_text(text: str) -> str:
    return re.sub(r"([\\#<])", r"\\\1", text)


def unescape_text(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return re.sub(r"([\\#<:])", r"\\\1", role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = HEAD + escape_role(role) + MID
    body = escape_text(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one formatted turn; the exact inverse of format_turn."""
    at = formatted.index(MID)
    if not formatted.startswith(HEAD) or not formatted.endswith(END) or "\n</turn>\n" in formatted[: -len(END)]:
        raise ValueError("not a formatted turn")
    return unescape_role(formatted[len(HEAD) : at]), unescape_text(formatted[at + len(MID) : -len(END)])


def turn_key(before: bytes, role: str, text: str) -> bytes:
    r, t = role.encode("utf-8", "surrogatepass"), text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(b"%b%d:%b%b" % (before, len(r), r, t), digest_size=KEY).digest()


def _length_of(vocabulary):
    """The number of tokens of a formatted turn."""
    if vocabulary is None:
        return len
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(vocabulary.value)
    tokenizer.encode_special_tokens = True
    return lambda text: len(tokenizer.encode(text, add_special_tokens=False).ids)


def _chain(vocabulary):
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Turns in order, one conversation after the other: (conv_id, depth, role, text, key, path); path at the last turn only."""
        names = ["conv_id", "depth", "role", "text", "key", "path"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.binary()]
        length = _length_of(vocabulary)

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        held = None  # the turn before, until it is known whether it is a last one
        path: list[bytes] = []
        rows, size = [], 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if held and held[0] != conv:
                    rows.append((*held, b"".join(path)))
                    path = []
                elif held:
                    rows.append((*held, None))
                key = turn_key(path[-1][:KEY] if path else b"", role, text)
                held = (conv, len(path), role, text, key)
                path.append(key + length(format_turn(role, text)[0]).to_bytes(8, "big"))
                size += len(text)
                if len(rows) >= 4000 or size > 8_000_000 and rows:
                    yield out(rows)
                    rows, size = [], 0
        if held:
            rows.append((*held, b"".join(path)))
        if rows:
            yield out(rows)

    return chain


def shared_entries(a: bytes, b: bytes) -> int:
    """How many first entries two paths have in common."""
    n, most = 0, min(len(a), len(b)) // ENTRY
    while n < most and a[n * ENTRY : (n + 1) * ENTRY] == b[n * ENTRY : (n + 1) * ENTRY]:
        n += 1
    return n


def lengths_of(path: bytes) -> list[int]:
    return [int.from_bytes(path[i + KEY : i + ENTRY], "big") for i in range(0, len(path), ENTRY)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves of a chunk in order of their paths: (rep, chunk, leaf, shared), shared entries with the leaf before, none for the first.
    Behind them a summary row: the first path, the last one, where its nodes start and how many of its entries the first leaf has;
    starts count from the last root of the chunk, as if the first leaf were new as a whole."""
    from pyspark import TaskContext

    kinds = [pa.int64()] * 4 + [pa.binary()] * 2 + [pa.list_(pa.int64())] + [pa.int64()] * 3
    names = ["rep", "chunk", "leaf", "shared", "first", "last", "starts", "kept", "roots", "end"]
    chunk = TaskContext.get().partitionId()
    first = last = None
    leaf = roots = end = kept = 0
    starts: list[int] = []
    for batch in batches:
        rows = []
        for rep, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            shared = shared_entries(path, last) if last is not None else 0
            if first is None:
                first, kept = path, len(path) // ENTRY
            elif not shared:
                roots, end, starts = roots + 1, 0, []
            kept = min(kept, shared) if leaf else kept
            del starts[shared:]
            for n in lengths_of(path[shared * ENTRY :]):
                starts.append(end)
                end += n
            rows.append((rep, chunk, leaf, shared, None, None, None, None, None, None))
            leaf, last = leaf + 1, path
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
    if leaf:
        row = (None, chunk, None, None, first, last, starts, 0 if roots else kept, roots, end)
        yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)


class Spine(NamedTuple):
    """What a chunk takes over: the tree it goes on with (or begins), that tree's tokens so far, and start and length of each turn of the path."""

    tree: int
    at: int
    turns: list[tuple[int, int]]


def spines_of(summaries: list) -> dict[int, Spine]:
    """The spine of each chunk, from the chunks' summaries in order."""
    out: dict[int, Spine] = {}
    last, stack, tree, end = b"", [], 0, 0  # of the chunk before: its last path, start and length of its turns, its last tree and that one's tokens
    for row in sorted(summaries, key=lambda r: r["chunk"]):
        shared = shared_entries(row["first"], last)
        spine = out[row["chunk"]] = Spine(tree, end, stack[:shared]) if shared else Spine(row["chunk"] << 40, 0, [])
        # counted as if the first leaf were new as a whole: in its tree all starts lie that much lower, and what was there before higher
        moved = spine.at - sum(lengths_of(row["first"][: shared * ENTRY])) if not row["roots"] else 0
        lengths = lengths_of(row["last"])
        taken = min(shared, row["kept"])
        stack = spine.turns[:taken] + [(s + moved, n) for s, n in zip(row["starts"][taken:], lengths[taken:], strict=True)]
        last, tree, end = row["last"], spine.tree if not row["roots"] else (row["chunk"] << 40) + row["roots"], row["end"] + moved
    return out


def _emit(vocabulary, spines):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes of whole chunks in depth-first order, with their place in their tree's token sequence."""
        length = _length_of(vocabulary)
        span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
        kinds = [pa.int64()] * 4 + [pa.string()] + [pa.int64()] * 3 + [pa.list_(span)] + [pa.int64()] * 3
        names = ["chunk", "tree", "leaf", "depth", "segment", "start", "length", "position", "attends", "loss_start", "loss_end", "conv_id"]
        now, tree, at, stack = None, 0, 0, []  # of the current path: (position behind it, intervals up to and with it)

        def push(start: int, n: int) -> tuple[int, tuple]:
            position, before = stack[-1] if stack else (0, ())
            # an ancestor that ends where this one starts is one interval with it
            own = (*before[:-1], (before[-1][0], start + n)) if before and before[-1][1] == start else (*before, (start, start + n))
            stack.append((position + n, own))
            return position, before

        for batch in batches:
            rows = []
            for chunk, leaf, depth, role, text, is_last, rep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if chunk != now:
                    now, (tree, at, turns), stack = chunk, spines.value[chunk], []
                    for start, n in turns:
                        push(start, n)
                    there, roots = len(turns), 0
                if leaf == 0 and depth < there:  # its chunk's first leaf: on the spine already
                    if is_last:
                        raise RuntimeError("a conversation that ends on the spine has its own leaf before")
                    continue
                if not depth and (leaf or there):
                    roots += 1
                    tree, at = (chunk << 40) + roots, 0
                segment, a, b = format_turn(role, text)
                del stack[depth:]
                n = length(segment)
                position, before = push(at, n)
                trained = role == TRAINED_ROLE
                rows.append((chunk, tree, leaf, depth, segment, at, n, position, [{"start": x, "end": y} for x, y in before], a if trained else None, b if trained else None, rep if is_last else None))
                at += n
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return emit


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads chunks back, in order of tree and start: for each node that ends conversations, digests of the turns that its intervals
    hold. The turns of the current tree in this chunk, and of its spine, are kept; intervals and position must fit them exactly."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, starts, held = None, [], []
    for batch in batches:
        rows = []
        for chunk, tree, start, n, position, attends, segment, a, b, rep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (chunk, tree) != now:
                now, starts, held = (chunk, tree), [], []
            starts.append(start)
            held.append((n, segment, a, b))
            if rep is None:
                continue
            turns, loss, chars, size, count, seen = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, 0
            for span in (*attends, {"start": start, "end": start + n}):
                if span["start"] == start and seen != position:
                    raise ValueError(f"position {position} behind {seen} tokens")
                at, k = span["start"], bisect_left(starts, span["start"])
                while at < span["end"]:
                    if k >= len(starts) or starts[k] != at:
                        raise ValueError(f"no turn starts at {at} of tree {tree}")
                    m, formatted, x, y = held[k]
                    role, text = parse_turn(formatted)
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    if x is not None:
                        masked = unescape_text(formatted[x:y])
                        loss.update(masked.encode("utf-8", "surrogatepass"))
                        chars += len(masked)
                    at, k, seen, size, count = at + m, k + 1, seen + m, size + len(formatted), count + 1
            rows.append((rep, count, turns.hexdigest(), chars, loss.hexdigest(), size))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


class Trees(NamedTuple):
    """nodes: a row for each turn that is emitted: chunk, tree, leaf, depth (leaf and depth are its place in the chunk's depth-first order),
    segment (the formatted turn), start and length (in tokens of the tree's sequence), position (of its first token on its path), attends
    (intervals of the tree's tokens before it that it sees), loss_start and loss_end (code points of the segment under the
    loss mask; null: none) and conv_id (the conversation it ends, of several equal ones the smallest id). members: conv_id and that
    smallest id as rep. spines: chunk, tree and start of the turns of earlier chunks that a chunk's nodes attend to."""

    nodes: DataFrame
    members: DataFrame
    spines: DataFrame


def prefix_trees(conversations: DataFrame, tokenizer_path: str | None = None, chunk_turns: int = 4096) -> Trees:
    """The trees of all conversations, one for each first turn; every prefix that occurs is emitted once.

    Turns of a conversation are taken by turn, null first, then by role and text; null roles and texts are empty; rows that
    repeat are turns of their own. Rows without conv_id belong to no conversation and are left out. Other columns are
    ignored. Empty tables give empty ones. A turn's key needs the one before it, so one conversation is chained in one task, as a
    stream; chunks have some chunk_turns turns of paths, or one longer path. The driver sees two paths a chunk.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    vocabulary = None
    if tokenizer_path:
        with open(tokenizer_path, encoding="utf-8") as f:
            vocabulary = spark.sparkContext.broadcast(f.read())  # one file of a few MB
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id is not null")
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = shared_table(ordered.mapInArrow(_chain(vocabulary), "conv_id long, depth long, role string, text string, key binary, path binary"), "turns")
    ends = turns.where("path is not null")
    leaves = shared_table(ends.groupBy(F.col("key").alias("key")).agg(F.min("conv_id").alias("rep"), F.first("path").alias("path"), F.count("*").alias("n")), "leaves")
    sizes = leaves.agg(F.coalesce(F.sum(F.octet_length("path")), F.lit(0)).alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    partitions = min(100_000, 1 + sizes["bytes"] // (ENTRY * chunk_turns))
    in_order = leaves.select("rep", "path").repartitionByRange(partitions, "path").sortWithinPartitions("path")
    summary = "first binary, last binary, starts array<long>, kept long, roots long, end long"
    placed = shared_table(in_order.mapInArrow(_chunks, f"rep long, chunk long, leaf long, shared long, {summary}"), "placed")
    spines = spines_of(placed.where("first is not null").collect())  # one row a chunk
    new = turns.join(placed.where("first is null").select("rep", "chunk", "leaf", "shared"), F.col("conv_id") == F.col("rep")).where("depth >= shared")
    by_chunk = new.select("chunk", "leaf", "depth", "role", "text", F.col("path").isNotNull().alias("is_last"), "rep").repartition("chunk").sortWithinPartitions("chunk", "leaf", "depth")
    schema = "chunk long, tree long, leaf long, depth long, segment string, start long, length long, position long, attends array<struct<start:long,end:long>>, loss_start long, loss_end long, conv_id long"
    nodes = shared_table(by_chunk.mapInArrow(_emit(vocabulary, spark.sparkContext.broadcast(spines)), schema), "nodes")  # one path a chunk
    members = join_counted(ends.select("conv_id", "key"), leaves.select("key", "rep", "n"), "key", sizes["n"]).select("conv_id", "rep")
    taken = [(chunk, spine.tree, start) for chunk, spine in spines.items() for start, _ in spine.turns]
    return Trees(nodes, members, spark.createDataFrame(taken, "chunk long, tree long, start long"))


def read_back(nodes: DataFrame, members: DataFrame, spines: DataFrame) -> DataFrame:
    """Each conversation as the emitted trees have it, by positions and attention intervals: n_turns, digests of turns and of the
    text under the loss mask, lengths. A null conv_id has no row; an empty table gives an empty one."""
    cols = ["tree", "start", "length", "position", "attends", "segment", "loss_start", "loss_end"]
    taken = spines.withColumnRenamed("chunk", "by").join(nodes.select(*cols), ["tree", "start"]).select(F.col("by").alias("chunk"), *cols, F.lit(None).cast("long").alias("conv_id"))
    flat = nodes.select("chunk", *cols, "conv_id").unionAll(taken).repartition("chunk").sortWithinPartitions("chunk", "tree", "start")
    got = flat.mapInArrow(_digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    counted = got.withColumnRenamed("conv_id", "rep").join(members.groupBy("rep").agg(F.count("*").alias("n")), "rep")
    return join_counted(members, counted, "rep", members.count()).drop("rep")
