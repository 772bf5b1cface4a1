"""Near-duplicate components: one-permutation hashing, optimal densification, banded buckets, star-shaped edges.

Plan: (1) one pass turns each text into its shingle set's digest and its band keys; (2) equal sets collapse to their
smallest id, so a group of copies costs one row from here on; (3) every band bucket has a centre, its smallest id, and each
set is compared with the smallest centre of its buckets, on full sets: a star of at most one candidate edge a set; (4) what
that links are classes already, and a bucket is done where all its members are in one; (5) the buckets left join classes up to parts, and
members of a part that are in different classes are compared, what is outside the part's largest class with each other and
with that class. So every pair that shares a bucket is linked or was compared, and a group of near copies costs its size, not its
square. Groups are dealt in chunks of GROUP_ROWS and GROUP_BYTES, so no task holds a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.components import connected_components
from sparkweft.llm.shared import WordHash, free_names, id_filter, join_counted, shared_table, shingle_sequence, small_batches

BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Sets, and bytes of shingle hashes, that a comparing group may have on each side.
GROUP_ROWS, GROUP_BYTES = 512, 4_000_000


def _probe_table(bins: int, tries: int = 64) -> np.ndarray:
    """For each bin the order in which it borrows from others: a hash of (bin, attempt), as optimal densification asks."""
    i, t = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(1, tries + 1, dtype=np.uint64), indexing="ij")
    x = (i * np.uint64(0x9E3779B97F4A7C15)) ^ (t * np.uint64(0xC2B2AE3D27D4EB4F))
    for s in (30, 27, 31):
        x ^= x >> np.uint64(s)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(33)) % np.uint64(bins)).astype(np.int64)


_PROBES = _probe_table(BINS)


def signature(shingles: np.ndarray) -> np.ndarray:
    """BINS minima of one hash over a non-empty set of distinct shingle hashes, empty bins filled by borrowing."""
    h = np.sort(shingles * np.uint64(0xD6E8FEB86659FD93) ^ (shingles >> np.uint64(32)))
    bins = ((h >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    sig = np.full(BINS, EMPTY)
    sig[bins[at].astype(np.int64)] = h[at]
    full = sig != EMPTY
    if not full.all():
        out, todo = sig.copy(), np.flatnonzero(~full)
        for t in range(_PROBES.shape[1]):
            src = _PROBES[todo, t]
            hit = full[src]
            out[todo[hit]] = sig[src[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        else:  # few full bins: the next full one round the circle
            where = np.flatnonzero(full)
            out[todo] = sig[where[np.searchsorted(where, todo) % len(where)]]
        sig = out
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A signed 64-bit key for each band; the band's number is part of it."""
    raw = sig.tobytes()
    step = ROWS * 8
    return np.array([xxhash.xxh3_64_intdigest(raw[b * step : (b + 1) * step], b) for b in range(BANDS)], np.uint64).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        n, digest, keys = [], [], []
        for text in batch.column(2):
            s = np.unique(shingle_sequence(text.as_py(), cache))
            n.append(len(s))
            digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            keys.append(band_keys(signature(s)) if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "row_key", "n_shingles", "digest", "band_keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHash()
    for batch in batches:
        for at in range(0, batch.num_rows, 512):  # sets are larger than texts: small batches out
            part = batch.slice(at, 512)
            sets = [np.unique(shingle_sequence(t.as_py(), cache)).tobytes() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "shingles"])


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on whole sorted sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    same = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * same >= percent * (len(a) + len(b) - same)


def link_forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, side: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Verified links that join up all linked documents of one part; with side, only those between side 0 and side 1; with known,
    documents of the same known class count as connected.

    Pairs already connected are skipped. Signatures rule out pairs whose estimate is six deviations below the threshold.
    """
    n = len(ids)
    root = np.arange(n) if known is None else np.unique(known, return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    sigs = np.stack([signature(s) for s in sets])
    t = percent / 100
    floor = np.floor((t - 6 * np.sqrt(t * (1 - t) / np.minimum(BINS, sizes))) * BINS)
    out = []
    votes = np.zeros(n)  # the most typical documents first: they connect most, and what is connected is skipped
    for c in range(0, BINS, 8):
        _, inv, count = np.unique(sigs[:, c], return_inverse=True, return_counts=True)
        votes += count[inv]
    for i in np.argsort(-votes, kind="stable"):
        can = (root != root[i]) & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        if side is not None:
            can &= side != side[i]
        js = np.flatnonzero(can)
        if not len(js):
            continue
        est = (sigs[js] == sigs[i]).sum(1)
        for j in js[est >= np.minimum(floor[js], floor[i])]:
            if root[j] != root[i] and linked(sets[i], sets[j], percent):
                root[root == root[j]] = root[i]
                out.append((int(ids[i]), int(ids[j])))
    return out


def _links(rows: list[tuple[int, int]]) -> pa.Table:
    return pa.table({"a": pa.array([x for x, _ in rows], pa.int64()), "b": pa.array([x for _, x in rows], pa.int64())})


def _with_centre(percent: int):
    def compare(key, table):
        """Members of one chunk of a star with their centre."""
        centre = key[0].as_py()
        ids = table.column("rep").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        middle = [x for i, x in zip(ids, sets, strict=True) if i == centre]
        return _links([(i, centre) for i, x in zip(ids, sets, strict=True) if i != centre and any(linked(x, m, percent) for m in middle)])

    return compare


def _across(percent: int):
    def compare(key, table):
        """Members of two chunks of a part, as far as they are in different classes."""
        ids, known, side = (table.column(n).to_numpy() for n in ("rep", "known", "side"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        return _links(link_forest(ids, sets, percent, side if len(set(side.tolist())) > 1 else None, known) if len(ids) > 1 else [])

    return compare


def _candidate_links(rows: DataFrame, classes: DataFrame, n_classes: int, percent: int, group_rows: int) -> DataFrame:
    """(a, b): verified links that join up all pairs of classes that share a bucket and are similar."""
    size = (F.col("size") * 8 + 8 * BINS).alias("size")
    buckets = classes.select("rep", size, F.explode("band_keys").alias("bucket"))
    centres = buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last"), F.count("*").alias("n")).where("centre <> last").select("bucket", "centre", "n")
    shared = shared_table(join_counted(buckets, shared_table(centres, "centres"), "bucket", BANDS * n_classes), "shared")
    reps = shared_table(shared.groupBy("rep").agg(F.min("centre").alias("centre"), F.first("size").alias("size")), "reps")
    maybe = id_filter(reps, "rep")  # most documents share no bucket: their texts stay where they are
    texts = rows.where(maybe(F.col("doc_id"))).select(F.col("doc_id").alias("rep"), "text").join(reps.select("rep"), "rep")
    sets = shared_table(texts.select("rep", "text").mapInArrow(_sets, "rep long, shingles binary"), "sets")
    chunks_of = lambda n, size: F.greatest(F.lit(1), F.ceil(n / F.lit(group_rows)), F.ceil(size / F.lit(GROUP_BYTES))).cast("int")
    chunk = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    # stars: a centre goes to each chunk of its members
    stars = reps.where("rep <> centre").groupBy("centre").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    stars = shared_table(stars.select("centre", "n", chunks_of(F.col("n"), F.col("size")).alias("chunks")), "stars")
    members = join_counted(reps.where("rep <> centre").select("rep", "centre"), stars, "centre", n_classes).select("rep", "centre", chunk(F.col("chunks")).alias("chunk"))
    dealt = members.unionByName(stars.select(F.col("centre").alias("rep"), "centre", each(F.col("chunks")).alias("chunk")))
    first = shared_table(dealt.join(sets, "rep").groupBy("centre", "chunk").applyInArrow(_with_centre(percent), "a long, b long"), "links")

    # buckets whose members are not all in one class yet join classes up to parts
    known = shared.join(connected_components(first).select(F.col("node").alias("rep"), "root"), "rep", "left").select("rep", "size", "bucket", F.coalesce("root", "rep").alias("known"))
    known = shared_table(known, "known")
    left = shared_table(known.groupBy("bucket").agg(F.min("known").alias("least"), F.max("known").alias("most"), F.count("*").alias("n")).where("least <> most").select("bucket", "least", "n"), "left")
    open_rows = shared_table(join_counted(known, left, "bucket", BANDS * n_classes), "open")
    edges = shared_table(open_rows.where("known <> least").select(F.col("known").alias("a"), F.col("least").alias("b")).distinct(), "class-edges")
    rooted = connected_components(edges).withColumnsRenamed({"node": "known", "root": "part"})
    in_class = open_rows.groupBy("known").agg(F.count("*").alias("n"))
    in_part = join_counted(open_rows.select("rep", "size", "known"), shared_table(rooted.join(in_class, "known"), "parts"), "known", BANDS * n_classes)
    mine = shared_table(in_part.distinct(), "members")
    sizes = mine.groupBy("part", "known").agg(F.count("*").alias("k"), F.sum("size").alias("s")).groupBy("part").agg(
        F.max_by(F.struct("known", "k", "s"), F.struct("k", "known")).alias("base"), F.sum("k").alias("n"), F.sum("s").alias("s")
    )
    sizes = sizes.select("part", F.col("base.known").alias("base"), "n", chunks_of(F.col("base.k"), F.col("base.s")).alias("base_chunks"), chunks_of(F.col("n") - F.col("base.k"), F.col("s") - F.col("base.s")).alias("rest_chunks"))
    split = join_counted(mine, shared_table(sizes, "sizes"), "part", n_classes)
    base = split.where("known = base").select("rep", "known", "part", each(F.col("rest_chunks")).alias("x"), chunk(F.col("base_chunks")).alias("y"), F.lit(True).alias("with_base"), F.lit(1).alias("side"))
    rest = split.where("known <> base").withColumn("chunk", chunk(F.col("rest_chunks")))
    rest_base = rest.select("rep", "known", "part", F.col("chunk").alias("x"), each(F.col("base_chunks")).alias("y"), F.lit(True).alias("with_base"), F.lit(0).alias("side"))
    rest_rest = rest.withColumn("other", each(F.col("rest_chunks"))).select(
        "rep", "known", "part", F.least("chunk", "other").alias("x"), F.greatest("chunk", "other").alias("y"), F.lit(False).alias("with_base"), F.when(F.col("chunk") > F.col("other"), 1).otherwise(0).alias("side"),
    )
    met = base.unionAll(rest_base).unionAll(rest_rest).join(sets, "rep")
    return first.unionAll(met.groupBy("part", "with_base", "x", "y").applyInArrow(_across(percent), "a long, b long"))


def _judge(rows: DataFrame, percent: int, group_rows: int) -> DataFrame:
    """(doc_id, row_key, n_shingles, digest, component_id, kept) of rows (doc_id, row_key, text); row_key is carried."""
    small_batches(rows.sparkSession)
    schema = "doc_id long, row_key string, n_shingles long, digest binary, band_keys array<long>"
    sketches = shared_table(rows.select("doc_id", "row_key", "text").mapInArrow(_sketch, schema), "sketch")
    known = sketches.where("doc_id is not null and digest is not null")

    # equal sets: one class each, named by its smallest id; what hangs on the set is the same in all its rows
    classes = shared_table(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("band_keys").alias("band_keys"), F.count("*").alias("n")), "classes")
    totals = classes.agg(F.count("*").alias("classes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    merged = connected_components(_candidate_links(rows, classes, totals["classes"], percent, group_rows))

    # rows whose set is theirs alone and links with nothing are their own component and need no join
    named = classes.join(merged, classes.rep == merged.node, "left").where("n > 1 or root is not null").select("digest", F.coalesce("root", "rep").alias("class_root"), "n")
    judged = join_counted(sketches.drop("band_keys"), named, "digest", totals["rows"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("class_root", "doc_id"), "doc_id"))
    out = judged.select("doc_id", "row_key", "n_shingles", "digest", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are runs of non-blank characters, A-Z lower-cased; a set holds the distinct 5-word shingles. A pair with a
    similarity of at least percent shares a bucket but for a chance of (1 - s^5)^32: 7e-9 at 0.85, 3e-6 at 0.8. Null, empty and
    blank texts have an empty set, link with nothing and are kept. A null id passes through with a null component
    and is not kept. Rows that repeat an id are judged each by its own text. Other columns of the input are ignored.
    An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("row_key"), F.col(text_col).cast("string").alias("text"))
    return _judge(rows, percent, group_rows).select("doc_id", "n_shingles", "component_id", "kept")


def without_duplicates(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each component; all columns are as they are.

    The rows of the smallest id stay. Of those of one shingle set one stays, with the least text key, and of rows with the
    same id and text the first by all columns as JSON. Rows of one id with other texts are judged each by its own: one may go
    and the other stay. Empty texts are copies only of the same id's. A row without id takes part under a number of its
    text, above the ids, so that a copy with an id goes before it. An empty table gives an empty one.

    Only rows that may be dropped or repeated are moved to be decided on; the filter that finds them has a fixed size,
    and the join behind it is exact.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    key = F.concat_ws(":", F.xxhash64(text), F.xxhash64(F.lit(1), text), F.col(text_col).isNull().cast("int"))
    number = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64(text), 3)
    own = F.coalesce(F.col(id_col).cast("long"), number)
    rows = docs.select(own.alias("doc_id"), key.alias("row_key"), F.col(text_col).cast("string").alias("text"))
    judged = shared_table(_judge(rows, percent, GROUP_ROWS).select("doc_id", "row_key", "digest", "kept"), "judged")
    # of an id's rows in its own component the ones of one set are copies of each other
    per_set = judged.groupBy("doc_id", "digest", F.when(F.col("digest").isNull(), F.col("row_key")).alias("blank"))
    per_set = shared_table(per_set.agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"), F.min("row_key").alias("stays")), "per-set")
    suspect = id_filter(per_set.where("n > 1 or not kept"))

    names = free_names(docs, "_id", "_key")
    keyed = docs.withColumns(dict(zip(names, (own, key), strict=True)))
    maybe = keyed.where(suspect(F.col(names[0])))
    kept = per_set.where("kept").select(F.col("doc_id").alias(names[0]), F.col("stays").alias(names[1]), (F.col("n") > 1).alias("repeats"))
    decided = maybe.join(kept.drop("repeats"), names, "left_semi")
    again = kept.where("repeats").drop("repeats")
    once = decided.join(again, names, "left_anti")
    # partial aggregates, so that a row that repeats very often goes to one task once from each
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = decided.join(again, names, "left_semi").groupBy(*names).agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return keyed.where(~suspect(F.col(names[0]))).drop(*names).unionByName(once.drop(*names)).unionByName(first)
