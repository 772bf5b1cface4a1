"""Importance resampling towards a target corpus, on hashed n-grams whose CRCs are composed, never read off a string.

CRC-32 is linear over GF(2): crc(A B) is crc(A) shifted by the length of B, xor crc(B), and a shift by n bytes is a 32 x 32
bit matrix, a power of the one for a single byte. So each word's CRC is worked out once, and the CRC of every run of words
follows from those of its words and their lengths, in vectors over a whole batch.

Plan: one pass over each corpus counts features by bucket, one array for each task; the gains of the buckets are a fixed number of
values; a second pass weighs each document and writes a narrow row, and one range shuffle of these ranks them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import numbered, shared_table, small_batches

#: Reflected generator polynomial of CRC-32 (fixed value).
POLYNOMIAL = 0xEDB88320
#: Words below this length have a table of their own for their shift, longer ones go by powers of two.
SHORT = 64
#: A-Z to a-z, other ASCII that is neither letter nor digit to a blank; bytes from 128 on are of words.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _times(matrix: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The GF(2) matrix, given by the images of the 32 bits, times each vector."""
    out = np.zeros(len(vectors), np.uint32)
    for bit in range(32):
        out ^= np.where(vectors >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0)).astype(np.uint32)
    return out


def _byte_shift() -> np.ndarray:
    """The matrix that shifts a CRC by one zero byte: that of one zero bit, squared three times."""
    m = np.array([POLYNOMIAL, *(1 << i for i in range(31))], np.uint32)
    for _ in range(3):
        m = _times(m, m)
    return m


def _tables(matrix: np.ndarray) -> np.ndarray:
    """The matrix as four tables by byte: its product is the xor of four look-ups."""
    return np.stack([_times(matrix, np.arange(256, dtype=np.uint32) << np.uint32(8 * k)) for k in range(4)])


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Tables of the shifts by 0 .. SHORT - 1 bytes, and of those by 2^0 .. 2^31 bytes."""
    one = _byte_shift()
    each, m = [], np.array([1 << i for i in range(32)], np.uint32)
    for _ in range(SHORT):
        each.append(_tables(m))
        m = _times(one, m)
    doubled, m = [], one
    for _ in range(32):
        doubled.append(_tables(m))
        m = _times(m, m)
    return np.stack(each), np.stack(doubled)


EACH, DOUBLED = _power_tables()


def _look(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """tables: one set for all (4, 256)."""
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


def shift(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRCs shifted by so many bytes each."""
    at = np.minimum(lengths, SHORT - 1)
    flat = EACH.reshape(-1)
    base = (at * 1024).astype(np.int64)
    out = flat[base + (crc & 255)] ^ flat[base + 256 + (crc >> 8 & 255)] ^ flat[base + 512 + (crc >> 16 & 255)] ^ flat[base + 768 + (crc >> 24)]
    if len(rest := np.flatnonzero(lengths >= SHORT)):
        some, n = crc[rest], lengths[rest]
        for k in range(int(n.max()).bit_length()):
            hit = n >> k & 1 == 1
            some[hit] = _look(DOUBLED[k], some[hit])
        out[rest] = some
    return out


SPACE = np.uint32(zlib.crc32(b" "))


class WordCrc(dict):
    """Word (bytes) to 8 bytes: its CRC-32 and its length. Forgets all once it holds limit words, so memory stays bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = zlib.crc32(word).to_bytes(4, "little") + len(word).to_bytes(4, "little")
        return out


def split_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def feature_crcs(texts: list[str | None], n: int, cache: WordCrc) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of words of each text; the CRC and the text of each run of 1 to n of its words, joined by one space)."""
    words = [split_words(t) for t in texts]
    count = np.array([len(w) for w in words], np.int64)
    packed = np.frombuffer(b"".join([cache[w] for ws in words for w in ws]), np.uint32).reshape(-1, 2)
    crc, length = packed[:, 0], packed[:, 1].astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), count)
    found, owners, run = [crc], [owner], crc
    for k in range(1, n):  # runs of k + 1 words: those of k words, a space, the next word
        run = shift(_look(EACH[1], run[:-1]) ^ SPACE, length[k:]) ^ crc[k:]
        inside = owner[k:] == owner[: len(owner) - k]
        found.append(run[inside])
        owners.append(owner[k:][inside])
        if not len(run):
            break
    return count, np.concatenate(found), np.concatenate(owners)


def bucket_counts(texts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all texts (a column text) fall into each bucket: one array for each task, added up by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, total = WordCrc(), np.zeros(buckets, np.int64)
        for batch in batches:
            _, crc, _ = feature_crcs(batch.column(0).to_pylist(), n, cache)
            total += np.bincount(crc % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    small_batches(texts.sparkSession)
    out = np.zeros(buckets, np.int64)
    for row in texts.select(F.col("text").cast("string")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most buckets rows
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed target share over the smoothed source share of each bucket."""
    b, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((y + 1) * (s + b) / ((x + 1) * (t + b)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def gumbel(seed: int, doc_id: int | None) -> int:
    """floor(1000 g) of the Gumbel noise g that the seed and the id fix."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, n: int, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of (doc_id, text)."""
    buckets = len(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCrc()
        for batch in batches:
            count, crc, owner = feature_crcs(batch.column(1).to_pylist(), n, cache)
            features = np.bincount(owner, minlength=len(count))
            sums = np.bincount(owner, weights=gains[crc % buckets].astype(np.float64), minlength=len(count)).astype(np.int64)  # whole numbers below 2^53
            weight = np.where(features > 0, sums // np.maximum(features, 1), 0)
            score = weight + np.array([gumbel(seed, i) for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in (count, features, weight, score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, n: int = 2, buckets: int = 10_000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_features, weight, score and, for the percent of documents of at least min_words words
    that score highest, rank (1, 2, ... by falling score, then id, then n_features); else null.

    Scores are importance weights with Gumbel noise, so the highest ones are a sample without replacement. target is any
    table with a text column. Null, empty and word-less texts have no features and weight 0, and are not drawn while
    min_words is above 0. A null id has the noise of an empty one and is ranked after other ids of its score. Rows that
    repeat an id are each a document. Empty documents give an empty table; an empty target is one whose buckets are all empty.
    Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    gains = bucket_gains(bucket_counts(rows.select("text"), n, buckets), bucket_counts(target.select(F.col("text")), n, buckets))
    weighed = shared_table(weigh(rows, gains, n, seed), "weighed")
    enough = F.col("n_words") >= min_words
    ranked, total = numbered(weighed.where(enough), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()], "rank")
    drawn = F.when(F.col("rank") < percent * total // 100, F.col("rank") + 1)
    out = ["doc_id", "n_features", "weight", "score"]
    return ranked.select(*out, drawn.alias("rank")).unionByName(weighed.where(~enough).select(*out, F.lit(None).cast("long").alias("rank")))
