"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Documents are partitioned by size: a partition holds those of up to u distinct shingles, u a power of two. In each, a
document has one one-permutation sketch of r * u bins, and an item's shingle that lies in the document is the least of its bin
with a chance of p = exp(-1/r) at least. A contained item has need = percent of its shingles in the document, so the number of its
shingles among the document's minima is binomial, need times p; from that each partition has a threshold for each item size, the
most minima that a contained item has but for a chance of MISS. Items are partitioned too: each is searched with the fewest bins
that give it a threshold of one at least; the smallest need a bin for every hash, so that every shingle is a minimum. What
reaches its threshold is verified against the document's whole set in the same task, so the documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import WordHash, per_worker, shingle_sequence, small_batches

#: Bins for each shingle of a partition's largest document; the last stands for a bin for every hash.
RATES = (1, 2, 4, 8, 0)
#: Chance to miss a contained item that the thresholds allow.
MISS = 1e-9
#: Text of the items that one pass over the documents holds in memory; more items take more passes.
ITEM_BYTES = 32_000_000


def bin_minima(ordered: np.ndarray, bins: int) -> np.ndarray:
    """The least hash in each bin of an ordered set of hashes; bins is a power of two, 0 a bin for every hash."""
    if not bins:
        return ordered
    b = ordered >> np.uint64(64 - bins.bit_length() + 1)
    first = np.ones(len(ordered), bool)
    first[1:] = b[1:] != b[:-1]
    return ordered[first]


def threshold(need: int, rate: int) -> int:
    """How many of need shingles are minima at a rate, but for a chance of MISS."""
    if not rate:
        return need
    p, below, k = math.exp(-1 / rate), 0.0, 0
    while k <= need:
        below += math.exp(math.lgamma(need + 1) - math.lgamma(k + 1) - math.lgamma(need - k + 1) + k * math.log(p) + (need - k) * math.log1p(-p))
        if below > MISS:
            return k
        k += 1
    return need


class ItemIndex:
    """Items by the rate they are searched with: their shingles, sorted, with the item each belongs to, and the items' thresholds."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], percent: int):
        self.ids, self.sets = [i for i, _ in items], [s for _, s in items]
        self.need = [-(-percent * len(s) // 100) for s in self.sets]
        self.least = np.ones(len(items), np.int64)
        of: dict[int, list[int]] = {}
        for i, need in enumerate(self.need):
            rate = next(r for r in RATES if threshold(need, r) >= 1 or not r)
            self.least[i] = max(1, threshold(need, rate))
            of.setdefault(rate, []).append(i)
        self.parts = {}
        for rate, own in of.items():
            flat = np.concatenate([self.sets[i] for i in own])
            order = np.argsort(flat, kind="stable")
            self.parts[rate] = flat[order], np.repeat(own, [len(self.sets[i]) for i in own])[order]

    def candidates(self, whole: np.ndarray) -> np.ndarray:
        """Items that reach the threshold among the minima of a document's ordered set."""
        upto = 1 << max(0, len(whole) - 1).bit_length()
        found = []
        for rate, (keys, owner) in self.parts.items():
            minima = bin_minima(whole, rate * upto)
            lo, hi = np.searchsorted(keys, minima), np.searchsorted(keys, minima, "right")
            hit = np.flatnonzero(hi > lo)
            if len(hit):
                items, times = np.unique(np.concatenate([owner[lo[k] : hi[k]] for k in hit]), return_counts=True)
                found.append(items[times >= self.least[items]])
        return np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)


def contained(seq: np.ndarray, index: ItemIndex) -> list[tuple[int | None, int, int]]:
    """(item, its shingles, those in the document) for each item that the document of these shingles contains."""
    if not len(seq) or not index.sets:
        return []
    whole = np.unique(seq)
    out = []
    for i in index.candidates(whole):
        s = index.sets[i]
        at = np.minimum(np.searchsorted(whole, s), len(whole) - 1)
        shared = int((whole[at] == s).sum())
        if shared >= index.need[i]:
            out.append((index.ids[i], len(s), shared))
    return out


def _index(items, percent: int, cache: WordHash) -> ItemIndex:
    sets = [(i, np.unique(shingle_sequence(t, cache))) for i, t in items.value]
    return ItemIndex([(i, s) for i, s in sets if len(s)], percent)


def _search(items, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker("words", WordHash)
        index = _index(items, percent, cache)
        for batch in batches:
            rows = [(d.as_py(), *hit) for d, t in zip(batch.column(0), batch.column(1), strict=True) for hit in contained(shingle_sequence(t.as_py(), cache), index)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item", "n_item_shingles", "n_shared"])

    return search


def _keep(items, percent: int, at: int):
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = per_worker("words", WordHash)
        index = _index(items, percent, cache)
        for batch in batches:
            yield batch.filter(pa.array([not contained(shingle_sequence(t.as_py(), cache), index) for t in batch.column(at)], pa.bool_()))

    return keep


def _texts(benchmark: DataFrame) -> DataFrame:
    """(item, text, bytes, times): each text once, under a number of its own."""
    rows = benchmark.select(F.col("text").cast("string").alias("text")).where("text is not null").groupBy("text").agg(F.count("*").alias("times"))
    return rows.select(F.xxhash64("text").alias("item"), "text", F.octet_length("text").alias("bytes"), "times")


def _blocks(texts: DataFrame, item_bytes: int):
    """The texts as broadcasts of at most item_bytes each, or of one text that has more; mostly one."""
    small_batches(texts.sparkSession)
    total = int(texts.agg(F.sum("bytes")).first()[0] or 0)
    deals = max(1, -(-2 * total // item_bytes))  # some half a block each, by hash, so that what comes to the driver at a time stays small
    block, size = [], 0
    for k in range(deals):
        for r in texts.where(F.pmod(F.col("item"), F.lit(deals)) == k).select("item", "text", "bytes").toLocalIterator():
            if block and size + r["bytes"] > item_bytes:
                yield texts.sparkSession.sparkContext.broadcast(block)
                block, size = [], 0
            block.append((r["item"], r["text"]))
            size += r["bytes"]
    yield texts.sparkSession.sparkContext.broadcast(block)


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared): each document row with each item it contains.

    An item is contained when at least percent of its distinct 5-word shingles (A-Z lower-cased) are among the
    document's. Null, empty and blank texts and items have no shingles and appear in no row. A text of under five words is one shingle,
    found only in the same text. Repeated rows on either side give repeated rows. Null ids are carried. Other columns are
    ignored. Empty tables give an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = _texts(benchmark)
    out = None
    for items in _blocks(texts, item_bytes):
        found = rows.mapInArrow(_search(items, percent), "doc_id long, item long, n_item_shingles long, n_shared long")
        out = found if out is None else out.unionAll(found)
    text = F.col("text").cast("string")
    ids = benchmark.select(F.xxhash64(text).alias("item"), F.col("item_id").cast("long").alias("item_id")).where(text.isNotNull())
    return out.join(ids, "item").select("doc_id", "item_id", "n_item_shingles", "n_shared")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, text_col: str = "text", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The rows of docs that contain no item, all columns as they are; what counts as contained is as in contaminated()."""
    out = docs.withColumn(text_col, F.col(text_col).cast("string"))
    for items in _blocks(_texts(benchmark), item_bytes):
        out = out.mapInArrow(_keep(items, percent, out.columns.index(text_col)), out.schema)
    return out
