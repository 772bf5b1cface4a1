import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import sharding as s
from sparkweft.llm.queries import op11_sharding
from tests.llm.conftest import frame, odd_texts


@pytest.mark.parametrize("n", [1, 2, 3, 15, 16, 17, 1000, 4096, 99_991])
def test_permutation_and_back(n):
    p = s.permute(np.arange(n), n, 7)
    assert sorted(p.tolist()) == list(range(n))
    assert (s.permute(p, n, 7, back=True) == np.arange(n)).all()
    assert n < 10 or (p != s.permute(np.arange(n), n, 8)).any()


def test_numbers_up_to_62_bits():
    n = (1 << 62) - 57
    at = np.array([0, 1, 12345678901234567, n - 1])
    p = s.permute(at, n, 3)
    assert ((p >= 0) & (p < n)).all() and (s.permute(p, n, 3, back=True) == at).all()


def test_walks_are_plain_feistel_steps():
    """One number after the other, in plain integers."""
    n, keys = 1000, s.round_keys(7)
    a, b = s.domain(n)
    assert a * b >= n > (a - 1) * b

    def mix(x, key):
        x = (x + key) % 2**32 * s.MULTIPLIERS[0] % 2**32
        x ^= x >> 15
        x = x * s.MULTIPLIERS[1] % 2**32
        return x ^ (x >> 13)

    def step(x):
        low, high = x % a, x // a
        for r in range(s.ROUNDS):
            if r % 2 == 0:
                low = (low + mix(high, keys[r])) % a
            else:
                high = (high + mix(low, keys[r])) % b
        return low + a * high

    def walk(x):
        x = step(x)
        while x >= n:
            x = step(x)
        return x

    assert s.permute(np.arange(n), n, 7).tolist() == [walk(i) for i in range(n)]


def test_odd_rows(spark, odd):
    rows = s.with_shards(odd, 4, 7).collect()
    assert len(rows) == len(odd_texts())
    count = [sum(r["shard"] == k for r in rows) for k in range(4)]
    assert max(count) - min(count) <= 1
    for k in range(4):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(count[k]))
    assert {"score", "label", "_id"} <= set(odd.columns) & set(rows[0].asDict())
    null = next(r for r in rows if r["doc_id"] is None)
    assert s.row_at(null["shard"], null["slot"], len(rows), 4, 7) == 0
    again = s.with_shards(odd.repartition(5, F.rand(1)), 4, 7).collect()
    pick = lambda rs: sorted((r["shard"], r["slot"], str(r["doc_id"]), str(r["text"])) for r in rs)
    assert pick(again) == pick(rows)


def test_names_of_results_and_empty_tables(spark, none):
    df = frame(spark, [(1, "a"), (2, "b")], "doc_id long, text string").withColumns({"shard": F.lit(99), "slot": F.lit("x"), "tie": F.lit(1), "number": F.lit(2), "spread": F.lit(3), "part": F.lit(4), "start": F.lit(5)})
    rows = s.with_shards(df, 2).collect()
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(0, 0), (1, 0)] and rows[0]["number"] == 2 and rows[0]["start"] == 5
    assert s.with_shards(none).count() == 0 and "slot" in s.with_shards(none).columns


def test_one_row_many_times_spreads(spark):
    df = spark.range(4000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("same").alias("text"))
    rows = s.with_shards(df, 16).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last")).collect()
    assert sorted((r["n"], r["last"]) for r in rows) == [(250, 249)] * 16


def test_files_hold_their_slots_in_order(spark, odd, tmp_path):
    s.write_shards(odd, str(tmp_path / "out"), shards=3, rows_per_file=2)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == len(odd_texts())
    for k in range(3):
        mine = spark.read.parquet(str(tmp_path / "out")).where(F.col("shard") == k).select("slot", F.input_file_name().alias("file")).collect()
        for f in {r["file"] for r in mine}:
            slots = [r["slot"] for r in mine if r["file"] == f]
            assert slots == sorted(slots) and len({x // 2 for x in slots}) == 1


def test_query_against_zlib(spark, tmp_path):
    frame(spark, odd_texts(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = op11_sharding(spark, str(tmp_path)).collect()
    want = sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in odd_texts())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}
