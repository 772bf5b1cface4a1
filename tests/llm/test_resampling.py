import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweft.llm import resampling as r
from tests.llm.conftest import frame, odd_texts, words

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, n=2):
    low = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
    w = WORDS.findall(low)
    return len(w), [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent, least, n, buckets, seed):
    """Every n-gram as a string."""
    code = lambda f: zlib.crc32(f.encode()) % buckets
    src, tgt = [0] * buckets, [0] * buckets
    for _, t in docs:
        for f in runs(t, n)[1]:
            src[code(f)] += 1
    for t in target:
        for f in runs(t, n)[1]:
            tgt[code(f)] += 1
    s, t = sum(src), sum(tgt)
    gain = [math.floor(1000 * math.log((tgt[b] + 1) * (s + buckets) / ((src[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        count, found = runs(text, n)
        weight = sum(gain[code(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, count])
    fit = sorted((o for o in out if o[5] >= least), key=lambda o: (-o[3], o[0] is None, o[0], o[1]))
    for k, o in enumerate(fit[: percent * len(fit) // 100]):
        o[4] = k + 1
    return sorted(str(tuple(o[:5])) for o in out)


def taken(df):
    return sorted(str((x["doc_id"], x["n_features"], x["weight"], x["score"], x["rank"])) for x in df.collect())


def test_shifts_compose_like_zlib():
    g = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 31, 63, 64, 65, 1000, 70_001):
        a, b = bytes(g.integers(0, 256, 5, np.uint8)), bytes(g.integers(0, 256, n, np.uint8))
        got = r.shift(np.array([zlib.crc32(a)], np.uint32), np.array([n]))[0] ^ np.uint32(zlib.crc32(b))
        assert int(got) == zlib.crc32(a + b)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_crcs_of_runs(n):
    texts = [t for _, t in odd_texts()] + ["x" * 300 + " y " + "z" * 65 + "\x00Ünï-ÇÖDÉ 7a_B", "\x7f{}", "one"]
    count, crc, owner = r.feature_crcs(texts, n, r.WordCrc(limit=50))
    for i, t in enumerate(texts):
        k, found = runs(t, n)
        assert count[i] == k
        assert sorted(crc[owner == i].tolist()) == sorted(zlib.crc32(f.encode()) for f in found)


def test_odd_rows_against_brute_force(spark, odd):
    target = [words(1, 40), None, "", "One two three", words(3, 25)]
    df = frame(spark, [(t,) for t in target], "text string")
    for percent, least in ((25, 20), (100, 0), (50, 1), (0, 20)):
        assert taken(r.resample(odd, df, percent, least)) == brute(odd_texts(), target, percent, least, 2, 10_000, 7)


def test_many_texts(spark):
    docs = [(i % 390, words(i % 97, 5 + i % 60)) for i in range(400)]
    target = [words(i, 30) for i in range(5)]
    got = r.resample(frame(spark, docs, "doc_id long, text string").repartition(7), frame(spark, [(t,) for t in target], "text string"), 25, 20, 3, 500, 11)
    assert taken(got) == brute(docs, target, 25, 20, 3, 500, 11)


def test_weights_prefer_the_target(spark):
    docs = [(i, words(1000 + i, 60)) for i in range(300)] + [(1000 + i, " ".join(words(5, 30).split() + words(2000 + i, 30).split())) for i in range(6)]
    rows = r.resample(frame(spark, docs, "doc_id long, text string"), frame(spark, [(words(5, 30),)] * 50, "text string")).collect()
    near, far = ([x["weight"] for x in rows if (x["doc_id"] >= 1000) == side] for side in (True, False))
    assert min(near) > max(far)


def test_empty_tables(spark, none, odd):
    empty = spark.createDataFrame([], "text string")
    assert r.resample(none, empty).count() == 0
    assert taken(r.resample(odd, empty)) == brute(odd_texts(), [], 25, 20, 2, 10_000, 7)


def test_one_text_many_times(spark):
    df = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit(words(1, 30)).alias("text"))
    ranks = [x["rank"] for x in r.resample(df, df.limit(1)).where("rank is not null").collect()]
    assert sorted(ranks) == list(range(1, 751))
