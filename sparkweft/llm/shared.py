"""Pieces that several training-data operators share: shared-folder tables, words, shingle hashes."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but these six ASCII blanks, which are what bytes.split() splits at.
BLANKS = "\x20\x09-\x0d"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where that is unset (tests), a temporary one."""
    global _own_dir
    if where := spark.conf.get("spark.checkpoint.dir", None):
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="sparkweft-shared-")
        atexit.register(__import__("shutil").rmtree, _own_dir, ignore_errors=True)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(f"file://{_own_dir}/rdd")
    return f"file://{_own_dir}"


#: Rows of whole texts in one Arrow batch; the default of 10,000 is meant for narrow rows.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Has the session send texts to Python in batches of at most BATCH_ROWS rows, so that neither side holds many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def new_shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/sparkweft-{spark.sparkContext.applicationId}/{what}-{uuid.uuid4().hex}"


def shared_table(df: DataFrame, what: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def forget(table: DataFrame) -> None:
    """Deletes what shared_table wrote, once what was made of it is written itself."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.shared_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined with table on key (inner or left); table has one row per key, with n, how many of the total rows have the key.

    A key with more rows than two average shuffle partitions is hot. There are fewer hot keys than half the shuffle partitions,
    whatever the input, so their part of table goes to the driver and to all tasks, and their rows stay where they lie; the
    others meet by a shuffle. Null keys match nothing and are not shuffled. Columns other than n are added.
    """
    spark = rows.sparkSession
    hot_from = 2 * total / int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = table.where(F.col("n") > hot_from).collect()  # fewer than half the shuffle partitions
    plain = table.drop("n")
    added = [c for c in plain.columns if c != key]
    known = rows.where(F.col(key).isNotNull())
    if found:
        hot = F.broadcast(spark.createDataFrame(found, table.schema).drop("n"))
        out = known.join(hot, key).unionByName(known.join(hot, key, "left_anti").join(table.where(F.col("n") <= hot_from).drop("n"), key, how))
    else:
        out = known.join(plain, key, how)
    if how == "left":
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in plain.schema if f.name in added]
        out = out.unionByName(rows.where(F.col(key).isNull()).select("*", *empty))
    return out.select(*rows.columns, *added)


def numbered(rows: DataFrame, order: list[Column], name: str) -> tuple[DataFrame, int]:
    """rows with name, their number from 0 in the given order, and how many there are.

    One range shuffle, then each partition numbers its own rows and starts where the ones before it end; the counts of the
    partitions are all that the driver sees. Rows that tie are split by where they came from, so that a group of any size
    spreads over partitions. rows are read twice, the first time to sample the ranges.
    """
    (spread,) = free_names(rows, "spread")
    dealt = rows.withColumn(spread, F.monotonically_increasing_id()).repartitionByRange(*order, F.col(spread)).sortWithinPartitions(*order, spread)
    table = shared_table(dealt.drop(spread).withColumn(name, F.monotonically_increasing_id()), "numbered")
    part, at = F.shiftright(name, 33), F.col(name).bitwiseAND(F.lit((1 << 33) - 1))
    counts = table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()  # one row for each partition of the shuffle
    starts, total = [], 0
    for row in sorted(counts):
        starts.append((row["part"], total))
        total += row["n"]
    by, start = free_names(table, "part", "start")
    known = F.broadcast(rows.sparkSession.createDataFrame(starts, f"`{by}` long, `{start}` long"))
    return table.withColumn(by, part).join(known, by).withColumn(name, at + F.col(start)).drop(by, start), total


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of df has, for columns that are taken out again."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bits of an id filter at most: 2 MB wherever it goes.
ID_FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame, id_col: str = "doc_id"):
    """A test that all of ids pass and most others don't, as a function of a column: a Bloom filter of at most ID_FILTER_BITS.

    For rows to be left out before a join that decides exactly. It is never larger than its bound; with more ids than it
    has room for it lets more through, and the join moves more. Null ids are ignored.
    """
    known = ids.where(F.col(id_col).isNotNull())
    bits = 1 << 12
    count = known.count()
    while bits < ID_FILTER_BITS and bits < 12 * count:
        bits *= 2
    probes = lambda c: [F.pmod(F.xxhash64(c, F.lit(s)), F.lit(bits)) for s in (11, 12, 13)]
    hit = known.select(F.explode(F.array(*probes(F.col(id_col)))).alias("bit"))
    words = hit.select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("word"))
    none = ids.sparkSession.range(bits // 64).select(F.col("id").alias("at"), F.lit(0).cast("long").alias("word"))
    words = words.unionByName(none).groupBy("at").agg(F.bit_or("word").alias("word"))  # bits / 64 rows
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    # a subquery's value: as a literal it would stand in full in every text Spark makes of a plan
    table = shared_table(words.agg(in_order.alias("words")), "id-filter").scalar()

    def passes(c: Column) -> Column:
        tests = [F.getbit(F.get(table, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in probes(c)]
        return tests[0] & tests[1] & tests[2]

    return passes


class WordHash(dict):
    """Word (bytes) to the 8 bytes of its 64-bit hash. Forgets all once it holds limit words, so memory stays bounded."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word).to_bytes(8, "little")
        return out


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint64)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n word hashes; order counts."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:k] ^ np.uint64(0x9E3779B97F4A7C15)
    for i in range(1, n):
        out = out * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
        out += hashes[i : i + k]
    out = out * np.uint64(0xC4CEB9FE1A85EC53)
    out ^= out >> np.uint64(29)
    return out * np.uint64(0x94D049BB133111EB)


def shingle_sequence(text: str | None, cache: WordHash, n: int = 5) -> np.ndarray:
    """Hashes of the n-word shingles of a whole text in order, A-Z lower-cased; with fewer words the whole sequence is
    one shingle; without words or text there are none."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words, cache)
    return window_hashes(h, min(n, len(words))) ^ np.uint64(0 if len(words) >= n else len(words))


def is_held_out(doc_id: Column) -> Column:
    """The fold that no model learns from: crc32 of the id as text, mod 5, is 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def per_worker(key: str, make):
    """make() once in each Python worker process, kept over its tasks until another key is asked for: one cache at a time."""
    import sys
    import types

    kept = sys.modules.setdefault("_sparkweft_worker", types.ModuleType("_sparkweft_worker")).__dict__
    if kept.get("key") != key:
        kept.pop("value", None)
        kept["key"], kept["value"] = key, make()
    return kept["value"]
