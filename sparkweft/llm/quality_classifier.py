"""Supervised subword embeddings: hashed word, character n-gram and word-pair vectors, averaged per document, softmax on top.

Trained by numpy stochastic gradient descent on a bounded sample of labelled rows. The score of a document is linear in
the average of its features' vectors, so for scoring each vector shrinks to one number, and a word to the sum of its own
features' numbers: executors get a table of BUCKETS floats and look words up.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from sparkweft.llm.shared import is_held_out, per_worker, shared_table, small_batches, window_hashes

BUCKETS, DIM = 1 << 18, 8
NGRAMS = (3, 4)
#: Labelled documents of each class to learn from, the first by a hash of the id. Their features, whole, go to a file of the driver's.
PER_CLASS = 1500
EPOCHS, RATE, SEED = 6, 0.5, 20_240
SAME_PAIR = 0

#: Bytes of text that are worked on at a time.
WORK_BYTES = 1_000_000
#: What scoring keeps of a word: its features' margins summed, their number, its hash.
WORD = [("m", "<f4"), ("n", "<u4"), ("h", "<u8")]


@dataclass
class WordTable:
    """Features of some words: buckets, the word (by its place) that each belongs to, and the words' hashes."""

    buckets: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray


def word_table(words: list[bytes]) -> WordTable:
    """Each word's features, the word itself and the character n-grams of <word>, for all words at once; case and marks count.

    The words, in their marks, lie one behind the other as an array of code points; an n-gram is a window of it that ends
    within its word. A word of any length has all its n-grams.
    """
    raw = b"<" + b"><".join(words) + b">"
    codes = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    nth = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)  # code points up to each byte
    ends = nth[np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2) - 1]
    owner = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
    buckets, owners = [np.array([xxh3_64_intdigest(w, 1) % BUCKETS for w in words], np.int64)], [np.arange(len(words))]
    for n in NGRAMS:
        at = np.arange(len(codes) - n + 1)
        at = at[at + n <= ends[owner[at]]]
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        buckets.append((h % np.uint64(BUCKETS)).astype(np.int64))
        owners.append(owner[at])
    return WordTable(np.concatenate(buckets), np.concatenate(owners), np.array([xxh3_64_intdigest(w) for w in words], np.uint64))


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of pairs of neighbouring words; all pairs of a word with itself share one."""
    if len(hashes) < 2:
        return np.empty(0, np.int64)
    out = (window_hashes(hashes, 2) % np.uint64(BUCKETS)).astype(np.int64)
    out[hashes[1:] == hashes[:-1]] = SAME_PAIR
    return out


def document_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one whole text."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    order = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    table = word_table(list(place))
    pairs = pair_buckets(table.hashes[order])
    ids, at = np.unique(np.concatenate((table.buckets, pairs)), return_inverse=True)
    times = np.concatenate((np.bincount(order)[table.owner], np.ones(len(pairs), np.int64)))
    return ids, np.bincount(at, times).astype(np.int64)


def _training_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for text in batch.column(2):
            i, c = document_features(text.as_py())
            ids.append(i.astype("<i4").tobytes())
            counts.append(c.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc_id", "label", "ids", "counts"])


class Stored(Sequence):
    """(buckets, counts) of documents in a file, read one at a time: a document has up to BUCKETS of each."""

    def __init__(self, file):
        self.file, self.places = file, []

    def add(self, ids: bytes, counts: bytes) -> None:
        self.places.append((self.file.seek(0, 2), len(ids)))
        self.file.write(ids + counts)

    def __len__(self) -> int:
        return len(self.places)

    def __getitem__(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        at, n = self.places[k]
        self.file.seek(at)
        both = self.file.read(2 * n)
        return np.frombuffer(both[:n], "<i4"), np.frombuffer(both[n:], "<f4")


@dataclass
class Model:
    """margin: by bucket, the difference of the two classes' logits that a feature alone would give; bias: that of no features."""

    margin: np.ndarray
    bias: float


def train(labels: np.ndarray, features: Sequence[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Softmax over averaged vectors, one document at a time, with a falling rate. Without both classes: the smoothed share."""
    n, ones = len(labels), int(labels.sum()) if len(labels) else 0
    if not ones or ones == n:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((ones + 1) / (n - ones + 1))))
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = np.where(labels == 1, n / (2 * ones), n / (2 * (n - ones))).astype(np.float32)
    step, steps = 0, EPOCHS * n
    for _ in range(EPOCHS):
        for k in rng.permutation(n):
            rate = RATE * (1 - step / steps) * weight[k]
            step += 1
            ids, counts = features[k]
            share = (counts / max(1.0, counts.sum()))[:, None]
            hidden = (vectors[ids] * share).sum(0)
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= 0.1 * rate * p
            # a feature's share of the average is small: scaled up to the size of a whole step over the document
            vectors[ids] -= rate * 20 * share * back
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


class WordMargins(dict):
    """Word to (sum of its features' margins, their number, its hash) as 16 bytes, in two generations of limit words each."""

    def __init__(self, margin: np.ndarray, limit: int = 120_000):
        super().__init__()
        self.margin, self.limit, self.old = margin, limit, {}

    def learn(self, words: list[bytes]) -> None:
        """Works the words out, as many at a time as make up some WORK_BYTES."""
        part, size = [], 0
        for i, w in enumerate(words, 1):
            part.append(w)
            size += len(w)
            if size >= WORK_BYTES or i == len(words):
                if len(self) >= self.limit:
                    self.old = dict(self)
                    self.clear()
                table = word_table(part)
                rows = np.empty(len(part), WORD)
                rows["m"] = np.bincount(table.owner, self.margin[table.buckets])
                rows["n"], rows["h"] = np.bincount(table.owner), table.hashes
                raw = rows.tobytes()
                self.update((x, raw[k : k + 16]) for x, k in zip(part, range(0, len(raw), 16), strict=True))
                part, size = [], 0

    def __missing__(self, word: bytes) -> bytes:
        if word not in self.old:
            self.learn([word])
            return self[word]
        out = self[word] = self.old[word]
        return out


def score_texts(texts: list[str | None], words: WordMargins, bias: float) -> np.ndarray:
    """Scores of whole texts; those in hand should be some WORK_BYTES or one text."""
    parts = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    words.learn(list(set().union(*parts).difference(words, words.old)))
    rows = np.frombuffer(b"".join(map(words.__getitem__, chain.from_iterable(parts))), WORD)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    owner = np.repeat(np.arange(len(parts)), lengths)
    pairs = pair_buckets(rows["h"])
    inside = owner[1:] == owner[:-1]  # pairs within one text
    total = np.bincount(owner, rows["m"], len(parts)) + np.bincount(owner[1:][inside], words.margin[pairs[inside]], len(parts))
    number = np.bincount(owner, rows["n"], len(parts)) + np.maximum(lengths - 1, 0)
    return 1 / (1 + np.exp(-np.clip(bias + total / np.maximum(number, 1), -50, 50)))


def score_text(text: str | None, words: WordMargins, bias: float) -> float:
    return float(score_texts([text], words, bias)[0])


def _score(model, at: int, name: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margin, bias = model.value
        words = per_worker(f"margins {xxh3_64_intdigest(margin.tobytes())}", lambda: WordMargins(margin))
        for batch in batches:
            scores, part, size = [], [], 0
            for t in batch.column(at):
                part.append(t.as_py())
                size += len(part[-1] or "")
                if size >= WORK_BYTES:
                    scores.append(score_texts(part, words, bias))
                    part, size = [], 0
            scores.append(score_texts(part, words, bias))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores))], names=[*batch.schema.names, name])

    return score


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most per_class labelled documents of each class, none held out, the first by a hash of the id.

    A document with several labels counts as 1 if any is; other values and nulls are no labels.
    """
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    one = clean.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    picked = [one.where(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    few = F.broadcast(picked[0].unionAll(picked[1]))  # 2 * per_class ids at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.join(few, "doc_id").select("doc_id", "label", "text")


def fit_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model learned from training_rows.

    Null and empty texts are documents without features, rows that repeat an id are documents each, labels without a
    document and documents without a label (null ids among them) are left out. Without labels of both classes, or in an
    empty table, every document scores the smoothed share of ones.
    """
    small_batches(docs.sparkSession)
    rows = training_rows(docs, labels, label_col, per_class, id_col, text_col).mapInArrow(_training_features, "doc_id long, label int, ids binary, counts binary")
    rows = shared_table(rows, "features").orderBy("doc_id", "ids", "counts", "label")
    labels_of = []
    with tempfile.TemporaryFile() as file:  # the driver's own
        features = Stored(file)
        for r in rows.toLocalIterator():
            features.add(bytes(r["ids"]), bytes(r["counts"]))
            labels_of.append(r["label"])
        return train(np.array(labels_of, np.int64), features)


def with_quality(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a column score_col (0 to 1, higher: label 1 likelier), which replaces one of that name.

    Empty, blank and null texts have no features and get the model's bias alone. Rows are scored one by one, and all other
    columns, null ids and repeated rows pass through. An empty table gives an empty one.
    """
    small_batches(docs.sparkSession)
    rows = docs.drop(score_col).withColumn(text_col, F.col(text_col).cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast((model.margin, model.bias))  # BUCKETS floats, 1 MB
    return rows.mapInArrow(_score(sent, rows.columns.index(text_col), score_col), T.StructType([*rows.schema.fields, T.StructField(score_col, T.DoubleType())]))


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, as with_quality scores it.

    A null id is carried and not held out; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    return with_quality(rows, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
