import os
import re

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from sparkweft.llm import queries
from sparkweft.llm.quality_classifier import fit_quality, score_text, WordMargins
from tests.llm.conftest import words
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_minhash_dedup import brute as near
from tests.llm.test_secret_scan import base, extra


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A small corpus: clean, junk, copies, near copies, leaks, secrets, odd rows."""
    d = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, words(i, 90)) for i in range(60)]
    docs += [(100 + i, words(100 + i, 90).replace(" ", "*** ")) for i in range(25)]
    docs += [(200, docs[3][1]), (201, docs[3][1] + " tail"), (202, docs[4][1] + " password=hunter2hunter2"), (203, words(300, 40) + " " + words(900, 30) + " " + words(301, 40))]
    docs += [(204, None), (205, ""), (206, words(206, 9000)), (207, docs[9][1]), (207, docs[9][1])]
    rows = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(i < 100), 0) for i, _ in docs if i < 200]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, words(900, 30))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows


def redacted(text):
    out, at = "", 0
    for a, _, b in sorted(base(text) + extra(text)):
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_against_brute_force(spark, tables):
    d, rows = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
    margins = WordMargins(model.margin)
    kept = [r for r in rows if score_text(r[1], margins, model.bias) >= cp.QUALITY_AT]
    assert {r[0] for r in rows if r[0] < 100} <= {r[0] for r in kept} and not any(100 <= r[0] < 200 for r in kept)
    good = {i for i, _, _, k in near([(r[0], r[1]) for r in kept], cp.NEAR_PERCENT) if k}
    kept = list({(r[0], r[1]): r for r in kept if r[0] in good}.values())
    leaks = {i for i, *_ in contained([(r[0], r[1]) for r in kept], [(1, words(900, 30))], cp.CONTAINED_PERCENT)}
    assert leaks == {203}
    kept = [(r[0], redacted(r[1]) if r[1] else r[1]) for r in kept if r[0] not in leaks]
    real = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for i, t in kept:
        ids = real.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, ids[at : at + 4096]) for k, at in enumerate(range(0, len(ids), 4096))]
    got = cp.run(spark, d).collect()
    assert sorted((r["doc_id"], r["piece"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()) for r in got) == sorted(want)
    assert any("password" in (r[1] or "") for r in rows) and not any(re.search("hunter2", t or "") for _, t in kept)


def test_stages_keep_the_columns(spark, tables):
    d, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), d).count() == 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), d).count() == 0


def test_registered():
    import __spark_entry__ as e

    known = e.queries()
    assert [n for n in known if re.match(r"op\d+_", n)] == list(queries.QUERIES) and "pipeline" in known
    assert os.path.exists(queries.tokenizer_path())


def test_near_dedup_keeps_clean_rows_without_id(spark):
    a, b, c = words(1, 90), words(2, 90), words(3, 90)
    rows = [(1, a), (None, a), (None, a + " tail"), (None, b), (None, b), (None, b + " tail"), (None, c), (2, None), (3, ""), (3, ""), (4, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect()]
    named, unnamed = [x for x in out if x[0] is not None], [t for i, t in out if i is None]
    assert sorted(named, key=str) == [(1, a), (2, None), (3, "")]
    assert len(unnamed) == 2 and c in unnamed and {b, b + " tail"} & set(unnamed)
