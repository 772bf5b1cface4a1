import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.llm import decontaminate as d
from tests.llm.conftest import frame, odd_texts, words
from tests.llm.test_minhash_dedup import shingles


def items():
    passage = words(1, 120).split()[20:60]
    return [(1, " ".join(passage)), (2, words(90, 30)), (3, None), (4, ""), (5, "one two"), (6, "A B c d e"), (7, " ".join(passage)), (8, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11"), (None, "a b c d e f"), (9, words(2, 60))]


def brute(docs, bench, percent):
    out = []
    for i, t in docs:
        s = shingles(t)
        for j, b in bench:
            q = shingles(b)
            if q and s and 100 * len(q & s) >= percent * len(q):
                out.append((i, j, len(q), len(q & s)))
    return sorted(out, key=str)


def test_against_brute_force(spark, odd):
    bench = frame(spark, items(), "item_id long, text string")
    want = brute(odd_texts(), items(), 80)
    assert len(want) > 8
    assert sorted((tuple(r) for r in d.contaminated(odd, bench).collect()), key=str) == want
    assert sorted((tuple(r) for r in d.contaminated(odd, bench, item_bytes=200).collect()), key=str) == want
    kept = d.without_contaminated(odd, bench)
    bad = {i for i, *_ in want}
    assert kept.columns == odd.columns
    assert sorted((str(r["doc_id"]) for r in kept.collect())) == sorted(str(i) for i, _ in odd_texts() if i not in bad)


def test_empty(spark, odd, none):
    bench = frame(spark, items(), "item_id long, text string")
    assert d.contaminated(none, bench).count() == 0
    assert d.contaminated(odd, bench.limit(0)).count() == 0
    assert d.without_contaminated(odd, bench.limit(0)).count() == len(odd_texts())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 6000), st.integers(0, 60), st.integers(1, 90), st.integers(0, 2**32))
def test_short_item_in_long_document(at, lost, size, seed):
    rng = np.random.default_rng(seed)
    doc = rng.integers(0, 2**64, 6100, dtype=np.uint64)
    item = doc[at : at + size].copy()
    item[: min(lost, size // 5)] = rng.integers(0, 2**64, min(lost, size // 5), dtype=np.uint64)
    index = d.ItemIndex([(7, np.unique(item)), (8, np.unique(rng.integers(0, 2**64, 30, dtype=np.uint64)))], 80)
    share = np.isin(np.unique(item), doc).mean()
    assert [x[0] for x in d.contained(doc, index)] == ([7] if 100 * share >= 80 else [])


def test_scattered_items_and_thresholds():
    """Items whose shingles lie anywhere in the document; thresholds are as likely to be reached as they say."""
    rng = np.random.default_rng(4)
    assert d.threshold(30, 0) == 30 and d.threshold(3, 1) == 0 and 1 <= d.threshold(24, 2) <= d.threshold(24, 8) < 24
    for size, n in ((5, 40), (30, 900), (30, 20_000), (200, 5000), (1000, 1500)):
        doc = rng.integers(0, 2**64, n, dtype=np.uint64)
        items = []
        for i in range(60):
            own = rng.choice(doc, size, replace=False)
            lost = i % 3 * size // 10
            own[:lost] = rng.integers(0, 2**64, lost, dtype=np.uint64)
            items.append((i, np.unique(own)))
        index = d.ItemIndex(items, 80)
        assert {i for i, *_ in d.contained(doc, index)} == {i for i, s in items if 100 * np.isin(s, doc).sum() >= 80 * len(s)}


def test_repeated_items(spark):
    text = words(1, 60)
    bench = spark.createDataFrame([(i % 7, text) for i in range(50)] + [(9, words(2, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"{words(3, 20)} {text}"), (2, words(5, 50))], "doc_id long, text string")
    out = d.contaminated(docs, bench, item_bytes=100).collect()
    assert sorted(r["item_id"] for r in out) == sorted(i % 7 for i in range(50)) and {r["doc_id"] for r in out} == {1}
    assert [r["doc_id"] for r in d.without_contaminated(docs, bench).collect()] == [2]
