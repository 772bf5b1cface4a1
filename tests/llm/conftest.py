import random

import pytest

#: Columns that every operator must ignore or carry, named like its own.
CLASH = {"score": 0.5, "kept": True, "n": 1, "part": 2, "label": 1, "rep": 3, "digest": "d", "length": 4, "task": 5, "component_id": 6, "rule": "r", "votes": "v", "batch": 7, "secrets_": 8, "_id": 9, "_key": 10, "_text": 11, "_base": 12, "_best": 13, "best": 14, "secrets": 15, "row_key": 16, "m": 17}

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(120_000))


def words(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n))


def odd_texts() -> list[tuple]:
    base = words(1, 120).split()
    near = base.copy()
    near[60] = "changed"
    far = base[:60] + words(2, 60).split()
    return [
        (1, " ".join(base)), (2, " ".join(base)), (3, None), (4, ""), (5, " \n\t\x0b\x0c\r "), (6, "One two"), (7, "one TWO"), (8, LONG), (9, LONG + " tail"),
        (10, " ".join(near)), (11, " ".join(far)), (12, "É\u00a0x\u2003y ﬁ İ \U0001f600"), (12, "É\u00a0x\u2003y ﬁ İ \U0001f600"), (None, words(3, 30)), (13, "a"), (14, "a b c d e"), (15, "a b c d e f"),
    ]


def frame(spark, rows, schema, clash=True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items() if k not in df.columns}) if clash else df


@pytest.fixture(scope="session")
def odd(spark):
    return frame(spark, odd_texts(), "doc_id long, text string")


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [], "doc_id long, text string")
