"""Shards of a reproducible shuffle: a Feistel permutation with cycle walking over global row numbers.

Row i of n goes to place p(i), a keyed permutation of 0 .. n - 1; its shard is p mod the number of shards and its slot p
div that number. So shards differ by one row at most, slots have no gaps, and both directions are computed from n and the
seed alone: permute() tells where a row went, row_at() which row lies at a place. No row is compared with another but to
be numbered, and that takes one range shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import free_names, numbered, shared_table

ROUNDS = 6
MASK = np.uint64(0xFFFFFFFF)
#: Odd multipliers of the round function, as SQL states them too.
MULTIPLIERS = (2654435761, 2246822519)


def domain(n: int) -> tuple[int, int]:
    """Sides (a, b) of the least near-square with a * b >= n: a number outside 0 .. n - 1 comes up once in about sqrt(n) steps."""
    a = max(1, int(np.ceil(np.sqrt(n))))
    while a * a < n:
        a += 1
    return a, max(1, -(-n // a))


def round_keys(seed: int) -> list[int]:
    return [int.from_bytes(hashlib.sha256(f"{seed}:{r}".encode()).digest()[:4], "big") for r in range(ROUNDS)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = ((x + np.uint64(key)) & MASK) * np.uint64(MULTIPLIERS[0]) & MASK
    x ^= x >> np.uint64(15)
    x = x * np.uint64(MULTIPLIERS[1]) & MASK
    return x ^ (x >> np.uint64(13))


def _step(x: np.ndarray, sides: tuple[int, int], keys: list[int], back: bool) -> np.ndarray:
    """All rounds over the square, or with back the rounds undone: even ones shift the low half, odd ones the high half."""
    a, b = (np.uint64(s) for s in sides)
    half = [x % a, x // a]
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        side = a if r % 2 == 0 else b
        shift = _mix(half[1 - r % 2], keys[r]) % side
        half[r % 2] = (half[r % 2] + (side - shift if back else shift)) % side
    return half[0] + a * half[1]


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """The places of row numbers below n, or with back the row numbers at places. Values that leave 0 .. n - 1 walk on along
    their cycle until they are back, which makes a permutation of the square one of the rows."""
    sides, keys = domain(n), round_keys(seed)
    out = np.asarray(rows).astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        out[todo] = _step(out[todo], sides, keys, back)
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """The global number of the row in this slot of this shard."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def place_of(number: Column, n: int, seed: int) -> Column:
    """permute() as a column function."""

    @F.pandas_udf("long")
    def place(rows: pd.Series) -> pd.Series:
        return pd.Series(permute(rows.to_numpy(), n, seed))

    return place(number)


def with_shards(rows: DataFrame, shards: int = 16, seed: int = 7, id_col: str = "doc_id", shard_col: str = "shard", slot_col: str = "slot") -> DataFrame:
    """rows with shard (int) and slot (long), the shuffled place of each.

    The global number is the rank by id (null first) and then by a hash of the whole row as JSON, so the result depends on
    neither partitions nor order of the input; rows that tie are equal, and which of them has which place can't be told.
    Repeated ids and repeated rows, texts of any length and null or empty ones all are rows as any other, spread over the
    shards. An empty table gives an empty one. Columns that have the names of the results are replaced. rows are read
    twice, as the range shuffle samples them first, and move through it whole: pass narrow rows where their places alone matter.
    """
    rows = rows.drop(shard_col, slot_col)
    tie, number = free_names(rows, "tie", "number")
    whole = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])))
    ranked, n = numbered(rows.withColumn(tie, whole), [F.col(id_col).asc_nulls_first(), F.col(tie).asc()], number)
    place = ranked.drop(tie).withColumn(number, place_of(F.col(number), n, seed))
    return place.withColumns({shard_col: F.pmod(number, F.lit(shards)).cast("int"), slot_col: F.expr(f"`{number}` div {shards}")}).drop(number)


def write_shards(rows: DataFrame, path: str, shards: int = 16, seed: int = 7, id_col: str = "doc_id", rows_per_file: int = 1_000_000) -> None:
    """rows as Parquet under path/shard=k, each file a run of rows_per_file slots in their order. An empty table writes no shard."""
    placed = with_shards(rows, shards, seed, id_col)
    (part,) = free_names(placed, "part")
    dealt = placed.withColumn(part, F.expr(f"slot div {rows_per_file}")).repartition("shard", part).sortWithinPartitions("shard", "slot")
    dealt.drop(part).write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)


def sharded_digests(docs: DataFrame, shards: int = 16, seed: int = 7) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of documents: with_shards over narrow rows, worked out from the texts once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return with_shards(shared_table(narrow, "narrow"), shards, seed)
