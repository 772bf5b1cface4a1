import itertools
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkweft.llm import packing as p
from sparkweft.llm.queries import tokenizer_path
from tests.llm.conftest import odd_texts

AWKWARD = ["İstanbul ΣΑΣ. it's <|endoftext|>x  a b c é ﬁ ²½ ×÷ Ⅷ don't.", "\u0301x y\u0085z\x1cq", "ªº µm Straße. STRASSE, x.,y", "<|ENDOFTEXT|> <|endoftext|>", "e\u0301 É. É,", "a." * 50, "\U0001f600 日本語 नमस्ते"]


def test_tokens_are_the_tokenizers():
    path = tokenizer_path()
    with open(path, encoding="utf-8") as f:
        own = p.TokenBytes(f.read(), limit=40)
    real = Tokenizer.from_file(path)
    assert own.plain
    for t in [*AWKWARD, *(t for _, t in odd_texts() if t)]:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == real.encode(t, add_special_tokens=False).ids, t[:60]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    own, real = _tokenizers()
    assert np.frombuffer(own.encode(text), "<u4").tolist() == real.encode(text, add_special_tokens=False).ids


_made = []


def _tokenizers():
    if not _made:
        with open(tokenizer_path(), encoding="utf-8") as f:
            _made.append((p.TokenBytes(f.read()), Tokenizer.from_file(tokenizer_path())))
    return _made[0]


def check(rows, docs, capacity):
    real = Tokenizer.from_file(tokenizer_path())
    got = sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["crc"]) for r in rows)
    want = []
    for i, t in docs:
        ids = real.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((str(i), k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert got == sorted(want)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_pieces_and_places(spark, odd, none):
    for capacity in (64, 4096):
        pieces = p.token_pieces(odd.repartition(4), tokenizer_path(), capacity)
        rows = p.pack(pieces.withColumn("crc", F.crc32("ids")).drop("ids"), capacity).collect()
        n = check(rows, odd_texts(), capacity)
        assert n <= -(-sum(r["length"] for r in rows) // capacity) + 1
    assert p.pack(p.token_pieces(none, tokenizer_path())).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 25), st.integers(1, 4), max_size=6), st.integers(0, 60))
def test_fullest(counts, room):
    items = [k for k, n in counts.items() for _ in range(n)]
    best = max((s for n in range(len(items) + 1) for c in itertools.combinations(items, n) if (s := sum(c)) <= room), default=0) if len(items) <= 12 else None
    got = p.fullest(sorted(counts, reverse=True), counts, room)
    assert sum(got) <= room and all(got.count(k) <= counts[k] for k in got)
    if best is not None:
        assert sum(got) == best


@settings(max_examples=50, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 300), max_size=30))
def test_plan_places_every_rank_once(histogram):
    plan = p.slack_plan(histogram, 100)
    bins = {}
    for length, n in histogram.items():
        rows = [r for r in plan if r[0] == length]
        for rank in range(n):
            r = max((x for x in rows if x[1] <= rank), key=lambda x: x[1])
            nth = rank - r[1]
            bins.setdefault(r[2] + nth // r[3], []).append((r[4] + nth % r[3] * length, length))
    assert sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 100


def test_near_the_bound():
    r = random.Random(4)
    histogram = {}
    for _ in range(5000):
        n = min(4096, max(1, int(r.lognormvariate(6, 1))))
        histogram[n] = histogram.get(n, 0) + 1
    plan = p.slack_plan(histogram, 4096)
    bins = max(b + (used // c if c else 0) for _, used, b, c, _ in plan) + 1
    total = sum(k * n for k, n in histogram.items())
    last = {}
    for length, first, b, c, _ in plan:
        last.setdefault(length, []).append((first, b, c))
    most = 0
    for length, rows in last.items():
        rows.sort()
        for (first, b, c), end in zip(rows, [*(x[0] for x in rows[1:]), histogram[length]], strict=True):
            most = max(most, b + (end - first - 1) // c)
    assert bins and most + 1 <= -(-total // 4096) * 1.01 + 1


def fewest(lengths, capacity):
    """The least number of sequences, by trying all ways."""
    best = len(lengths)

    def place(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i in range(len(bins)):
            if bins[i] + lengths[k] <= capacity and bins[i] not in bins[:i]:
                place(k + 1, [*bins[:i], bins[i] + lengths[k], *bins[i + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=9))
def test_sequences_against_the_fewest_possible(lengths):
    histogram = {k: lengths.count(k) for k in lengths}
    plan = p.slack_plan(histogram, 40)
    used = set()
    for length, n in histogram.items():
        rows = [r for r in plan if r[0] == length]
        for rank in range(n):
            r = max((x for x in rows if x[1] <= rank), key=lambda x: x[1])
            used.add(r[2] + (rank - r[1]) // r[3])
    assert len(used) <= fewest(sorted(lengths, reverse=True), 40) + 1
