"""Best-fit packing of token sequences by minimum bin slack over the histogram of lengths.

Only lengths matter to the packing, and there are at most `capacity` of them: the histogram goes to the driver, a plan of
at most that many steps comes back, and each piece finds its place from its length and its rank among pieces of that length.
Neither documents nor pieces are ever gathered, and no piece moves to be ranked: each task numbers its own, and one
running sum per length over the tasks' counts turns that into a rank.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkweft.llm.shared import per_worker, shared_table, small_batches

END_ID = 1
#: A word of letters that lower-case one by one and that normal forms leave alone.
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class TokenBytes(dict):
    """Blank-separated part of a text to its token ids as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and no token crosses it, so the ids of a text are those of its parts, one after the
    other. Parts are remembered in two generations of limit parts each: what is in use survives, memory stays bounded. Plain
    words go straight to the tokenizer's model, everything else through the whole tokenizer.
    """

    def __init__(self, vocabulary: str, limit: int = 300_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.model = self.tokenizer.model
        self.limit, self.old = limit, {}
        self.letters = [_byte_letters()[b] for b in range(256)]
        self.tail = {m: self._whole(m.decode()) for m in (b",", b".")}
        # plain words may only skip the other steps if these are the steps
        self.plain = all(self._word(w.lower()) == self._whole(w) for w in ("zürich", "Thonwhed", "a", "Ñandú")) and self._whole("Zürich.") == self._word("zürich") + self.tail[b"."]

    def _whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _word(self, word: str) -> bytes:
        text = word if word.isascii() else "".join([self.letters[b] for b in word.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(text)])

    def __missing__(self, raw: bytes) -> bytes:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        out = self.old.get(raw)
        if out is None:
            if self.plain and raw.isalpha() and raw.islower():
                out = self._word(raw.decode())
            elif self.plain and raw[-1:] in self.tail and _WORD.fullmatch(raw[:-1].decode("utf-8", "replace")):
                out = self[raw[:-1]] + self.tail[raw[-1:]]
            elif self.plain and (m := _WORD.fullmatch(raw.decode("utf-8", "replace"))):
                out = self._word(m[0].lower())
            else:
                out = self._whole(raw.decode("utf-8", "replace"))
        self[raw] = out
        return out

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        raw = text.encode("utf-8", "replace")
        if self.plain and b"<|" not in raw:  # A-Z go to lower case anyway; special tokens are told apart by case
            raw = raw.lower()
        return b"".join(map(self.__getitem__, raw.split()))


def _tokenize(vocabulary, capacity: int, key: str):
    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokens = per_worker(f"tokens {key}", lambda: TokenBytes(vocabulary.value))
        task, nth = TaskContext.get().partitionId(), Counter()
        end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = tokens.encode(text) + end
                    for piece, x in enumerate(range(0, len(ids), step)):
                        own = ids[x : x + step]
                        rows.append((doc, piece, x // 4, len(own) // 4, own, task, nth[len(own)]))
                        nth[len(own)] += 1
                cols = list(zip(*rows, strict=True)) or [[]] * 7
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids", "task", "nth"])

    return tokenize


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most capacity ids, kept as a table: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian), task, nth.

    A document is its ids and the end id; null and empty texts are the end id alone. Rows that repeat an id give a piece
    each, a null id is carried, other columns are ignored, an empty table gives an empty one. The vocabulary file is read
    on the driver and sent along.
    """
    small_batches(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # one file of a few MB, whatever the input
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, piece int, start long, length long, ids binary, task int, nth long"
    return shared_table(rows.mapInArrow(_tokenize(vocabulary, capacity, tokenizer_path), schema), "pieces")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """Lengths (each at most counts times) whose sum is as near to room as any, by subset sums in a bitset."""
    reach, full, steps = 1, 1 << room, []
    mask = (full << 1) - 1
    for length in lengths:
        left = min(counts[length], room // length) if length <= room else 0
        some = 1
        while left:
            some = min(some, left)
            new = (reach | (reach << (some * length))) & mask
            if new != reach:
                steps.append((length, some, reach))
                reach = new
                if reach & full:
                    break
            left -= some
            some *= 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, []
    for length, some, before in reversed(steps):
        if not before >> at & 1:
            out += [length] * some
            at -= some * length
    return out


def slack_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Minimum bin slack. Rows (length, first rank, first bin, copies a bin, offset in the bin), to be looked up by length and rank.

    A bin takes the longest length left and the combination of the others that fills it best; while all lengths of a
    combination last, the next bins take the same. So a step uses up a length, and there are at most capacity steps.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    used, bins, plan = Counter(), 0, []
    while left:
        order = sorted(left, reverse=True)
        top = order[0]
        left[top] -= 1
        combo = Counter([top, *fullest(order, left, capacity - top)])
        left[top] += 1
        times = min(left[k] // c for k, c in combo.items())
        offset = 0
        for k, c in sorted(combo.items(), reverse=True):
            plan.append((k, used[k], bins, c, offset))
            offset += c * k
            used[k] += c * times
            left[k] -= c * times
            if not left[k]:
                del left[k]
        bins += times
    return sorted(plan)


def _place(plan):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.array(plan.value, np.int64).reshape(-1, 5)
        keys = (table[:, 0] << 44) + table[:, 1]
        for batch in batches:
            names = batch.schema.names
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            rank = batch.column(names.index("rank")).to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else table[:0]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // np.maximum(row[:, 3], 1), row[:, 4] + nth % np.maximum(row[:, 3], 1) * length
            kept = [i for i, n in enumerate(names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(sequence), pa.array(offset)], names=[*(names[i] for i in kept), "sequence_id", "offset"])

    return place


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Pieces (with length, task and nth as token_pieces gives them) with sequence_id and offset; task and nth go, other columns stay."""
    counts = shared_table(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan = pieces.sparkSession.sparkContext.broadcast(slack_plan(histogram, capacity))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("nth") + F.col("before")).drop("task", "nth", "before")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(_place(plan), f"{fields}, sequence_id long, offset long")
