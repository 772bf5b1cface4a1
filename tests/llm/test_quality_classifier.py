import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkweft.llm import quality_classifier as q
from tests.llm.conftest import LONG, frame, odd_texts, words


def corpus(n=240):
    docs, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        docs.append((i, words(i, 60) if good else words(i, 60).replace(" ", "*** ")))
        labels.append((i, int(good), i % 7))
    return docs, labels


def test_held_out_accuracy_and_columns(spark):
    docs, labels = corpus()
    d = frame(spark, docs, "doc_id long, text string")
    lab = spark.createDataFrame([*labels, (3, None, 0), (999_999, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in q.score_quality(d, q.fit_quality(d, lab)).collect()}
    assert len(rows) == len(docs)
    truth = {i: y for i, y, _ in labels}
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [i for i in rows if rows[i]["held_out"]]
    assert sum((rows[i]["score"] >= 0.5) == truth[i] for i in held) >= 0.95 * len(held)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = corpus(90)
    d = frame(spark, docs, "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y, t) for i, y, t in labels]
    a, b = (q.fit_quality(d, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, flip))
    assert np.array_equal(a.margin, b.margin) and a.bias == b.bias


def test_odd_texts_and_missing_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    model = q.fit_quality(odd, empty)
    rows = q.score_quality(odd, model).collect()
    assert len(rows) == len(odd_texts()) and {r["score"] for r in rows} == {0.5}
    assert q.score_quality(none, model).count() == 0
    one = q.fit_quality(odd, spark.createDataFrame([(1, 1), (8, 1)], "doc_id long, quality int"))
    assert all(r["score"] > 0.5 for r in q.score_quality(odd, one).collect())
    carried = q.with_quality(odd, model)
    assert sorted(carried.columns) == sorted(odd.columns) and carried.where(F.col("kept")).count() == len(odd_texts())


def test_scoring_equals_the_model_it_shrinks():
    """The sum over word margins is the average of the features' margins of the whole document."""
    rng = np.random.default_rng(0)
    margin = rng.normal(size=q.BUCKETS).astype(np.float32)
    for text in ("one two two É three", LONG[:5000], "a"):
        ids, counts = q.document_features(text)
        want = 1 / (1 + np.exp(-(0.25 + (margin[ids].astype(float) * counts).sum() / counts.sum())))
        assert abs(q.score_text(text, q.WordMargins(margin, limit=50), 0.25) - want) < 1e-5


def test_training_is_repeatable():
    rng = np.random.default_rng(3)
    feats = [(rng.integers(0, q.BUCKETS, 20), np.ones(20, np.float32)) for _ in range(20)]
    y = np.array([i % 2 for i in range(20)])
    assert np.array_equal(q.train(y, feats).margin, q.train(y, feats).margin)


def test_long_documents_are_learned_from_whole(spark, monkeypatch):
    seen = []
    real = q.train
    monkeypatch.setattr(q, "train", lambda labels, features: (seen.extend((int(x), *features[k]) for k, x in enumerate(labels)), real(labels, features))[1])
    docs = [(i, words(i, 6000 if i % 4 == 0 else 20)) for i in range(24)]
    frame_of = spark.createDataFrame(docs, "doc_id long, text string")
    q.fit_quality(frame_of, spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int"))
    want = [(i % 2, *q.document_features(t)) for i, t in docs if zlib.crc32(str(i).encode()) % 5]
    assert len(seen) == len(want) and max(len(i) for _, i, _ in want) > 8_192
    for (x, i, c), (y, j, d) in zip(seen, want, strict=True):
        assert x == y and i.tolist() == j.tolist() and c.tolist() == d.tolist()


def test_features_against_a_plain_count():
    """Words, n-grams and pairs counted one by one; a word of any length has all its n-grams."""
    for text in ("ab ab é\U0001f600x a", "x" * 900 + " y", words(3, 40), ""):
        parts = text.split()
        grams = [f"<{w}>"[i : i + n] for w in parts for n in q.NGRAMS for i in range(len(w) + 3 - n)]
        ids, counts = q.document_features(text)
        assert counts.sum() == len(parts) + len(grams) + max(0, len(parts) - 1)
        one = {g: int(q.word_table([g.strip("<>").encode()]).buckets[0]) for g in parts}
        for w in set(parts):
            assert counts[np.searchsorted(ids, one[w])] >= parts.count(w)
        # equal grams share a bucket wherever they stand
        assert len(ids) <= len(set(parts)) + len(set(grams)) + max(0, len(parts) - 1)


def test_texts_are_scored_alike_alone_and_together():
    margin = np.random.default_rng(1).normal(size=q.BUCKETS).astype(np.float32)
    texts = [t for _, t in odd_texts()]
    together = q.score_texts(texts, q.WordMargins(margin, limit=20), 0.1)
    assert np.allclose(together, [q.score_text(t, q.WordMargins(margin), 0.1) for t in texts], atol=1e-6)
