import base64
import hashlib
import io

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.llm import warc as w
from tests.llm.conftest import LONG, frame

PAGES = [
    (1, "http://a/\r\nX: y", "<p>same</p>"), (2, None, "<p>same</p>"), (3, "http://c/%41", None), (4, "", ""), (5, "http://é/", LONG), (6, "u", "É\U0001f600"), (7, "v", "<p>same</p>"), (7, "v", "<p>same</p>"),
    (None, "n", "<p>same</p>"), (None, "n", "alone"), (-3, "m", "minus"),
]


def brute(rows, least=0):
    by = {}
    for i, _, h in rows:
        by.setdefault(h or "", []).append(i)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        first = max(ids, default=None) if len(by[h or ""]) > 1 and len(raw) >= least else i
        revisit = first is not None and first != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    df = frame(spark, PAGES, "page_id long, url string, html string").repartition(3)
    got = w.round_trip(df, with_payload=True, least_bytes=least).collect()
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got), key=str) == brute(PAGES, least)
    full = {(r["page_id"], bytes(r["payload"])) for r in got if r["record_type"] == "response"}
    assert (5, LONG.encode()) in full and (4, b"") in full
    assert {r["url"] for r in got} == {u for _, u, _ in PAGES}


def test_hot_payloads_and_rolled_archives(spark):
    rows = [(i, "u", None if i % 3 == 0 else f"<p>{i % 40 if i % 2 else i}</p>") for i in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    manifest = w.write_archives(df, w.new_shared_path(spark, "warc"), archive_bytes=6000)
    assert manifest.count() > 8 and manifest.agg({"records": "sum"}).first()[0] == 900
    got = w.read_archives(manifest).collect()
    assert sorted((tuple(r)[:1] + tuple(r)[2:6] for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert w.round_trip(frame(spark, [], "page_id long, url string, html string")).count() == 0


def archive(records):
    out = io.BytesIO()
    writer = w.ArchiveWriter(out, records)
    for r in records:
        writer.write(r)
    return out.getvalue()


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**40), 2**40)), st.one_of(st.none(), st.text(max_size=30)), st.binary(max_size=300)), min_size=1, max_size=8), st.integers(1, 50))
def test_records_come_back(rows, chunk):
    raw = archive([w.record_bytes(i, u, p, None, False) for i, u, p in rows])
    back = [w.parse_record(r) for r in w.read_frames(io.BytesIO(raw), chunk)]
    assert [(r[0], r[1], r[6]) for r in back] == rows


def test_damage_is_found():
    good = w.record_bytes(1, "u", b"payload " * 50, None, False)
    raw = archive([good, good])
    for bad in (raw[:3], raw[:-5], raw[8:], raw[:200] + b"\0\0\0\0" + raw[204:]):
        with pytest.raises(w.WarcError):
            [w.parse_record(r) for r in w.read_frames(io.BytesIO(bad))]
    for old, new in ((b"payload p", b"payload q"), (b"Content-Length: 4", b"Content-Length: 5"), (b"WARC/1.1", b"WARC/9.9"), (b"urn:page:1", b"urn:page:x"), (b"WARC-Type: response", b"WARC-Type: other")):
        with pytest.raises(w.WarcError):
            w.parse_record(good.replace(old, new, 1))
