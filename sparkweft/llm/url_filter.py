"""URL filters by a Bloom filter cascade, in DataFrame functions only.

Level 0 holds the listed keys, level 1 the keys of the corpus that level 0 lets through by mistake, level 2 the listed keys
that level 1 lets through, and so on until nothing is let through by mistake. Over the corpus's keys membership is exact,
and a query is a few bit tests in the scan's own stage: no join, no shuffle. Level 0 is sized by the number of listed
keys and of the corpus's keys so that the mistakes are about as many as the listed keys; the whole cascade stays within
a few bytes per listed key, whatever the corpus.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm.shared import free_names

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _values(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The keys as a table, from one literal that is parsed once."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


class Level:
    """One Bloom filter: words of 64 bits, k probes by double hashing with the level's own seeds."""

    def __init__(self, n: int, rate: float, seed: int):
        self.k = max(1, round(math.log2(1 / rate)))
        self.bits = max(64, math.ceil(n * self.k / math.log(2)))
        self.seed = seed
        self.words: list[int] = []

    def probes(self, key: Column) -> list[Column]:
        a, b = (F.shiftrightunsigned(F.xxhash64(key, F.lit(2 * self.seed + i)), 33) for i in (0, 1))
        b = b.bitwiseOR(F.lit(1))
        return [F.pmod(a + b * F.lit(i), F.lit(self.bits).cast("long")) for i in range(self.k)]

    def fill(self, keys: DataFrame) -> Level:
        """From a DataFrame with a column key; what comes back is bits / 64 words at most."""
        bit = keys.select(F.explode(F.array(*self.probes(F.col("key")))).alias("bit"))
        words = bit.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("word")).collect()
        self.words = [0] * -(-self.bits // 64)
        for r in words:
            self.words[r["at"]] = r["word"]
        return self

    def has(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # one constant that all probes look into
        at = F.filter(F.array(*self.probes(key)), lambda p: F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 0)
        return F.size(at) == 0


class Cascade:
    """Exact membership of listed keys over the keys of a corpus.

    The list is the caller's own, so it fits the driver; a cascade holds some 1.5 bits a listed key and doubling of the
    corpus's keys per listed key, and goes with the tasks. What the first level lets through by mistake is kept within ten
    times the list by its rate.
    """

    def __init__(self, universe: DataFrame, listed: list[str], n_universe: int, max_levels: int = 60):
        self.levels: list[Level] = []
        listed = sorted(set(listed))
        if not listed:
            return
        spark, own = universe.sparkSession, set(listed)
        rate = min(0.5, len(listed) * math.sqrt(0.5) / max(1, n_universe))
        while True:
            first = Level(len(listed), rate, 0).fill(_values(spark, listed))
            bound = 11 * len(listed) + 1000
            passed = [r["key"] for r in universe.where(first.has(F.col("key"))).distinct().limit(bound + 1).collect()]
            if len(passed) <= bound:
                break
            rate /= 16  # an unlucky or undercounted universe: fewer mistakes, so that they stay within the bound
        self.levels = [first]
        inside, outside = listed, sorted(k for k in passed if k not in own)  # the next level holds what the last let through by mistake
        while outside and len(self.levels) < max_levels:
            level = Level(len(outside), 0.5, len(self.levels)).fill(_values(spark, outside))
            through = sorted(r["key"] for r in _values(spark, inside).where(level.has(F.col("key"))).collect())
            self.levels.append(level)
            inside, outside = outside, through
        if outside:
            raise RuntimeError(f"{len(outside)} keys still pass after {max_levels} levels")

    def has(self, key: Column) -> Column:
        """Whether key is listed; exact for keys of the universe. The size of the expression depends on neither keys nor levels: all levels' words are one
        constant, and one function walks over them."""
        if not self.levels:
            return F.lit(False)
        words, about = [], []
        for i, level in enumerate(self.levels):
            about.append(F.struct(F.lit(i).alias("i"), F.lit(2 * level.seed).alias("seed"), F.lit(level.bits).cast("long").alias("bits"), F.lit(level.k).alias("k"), F.lit(64 * len(words)).cast("long").alias("start")))
            words += level.words
        table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")

        def passes(level: Column) -> Column:
            a, b = (F.shiftrightunsigned(F.xxhash64(key, level["seed"] + i), 33) for i in (0, 1))

            def set_at(i: Column) -> Column:
                bit = level["start"] + F.pmod(a + b.bitwiseOR(F.lit(1)) * i, level["bits"])
                return F.getbit(F.get(table, F.shiftright(bit, 6).cast("int")), (bit % 64).cast("int")) == 1

            return F.forall(F.sequence(F.lit(0), level["k"] - 1), set_at)

        stops = F.array_min(F.transform(F.filter(F.array(*about), lambda level: ~passes(level)), lambda level: level["i"]))
        return F.coalesce(stops, F.lit(len(self.levels))) % 2 == 1


def _candidates(host: Column, path: Column, labels: list[int], prefixes: list[int]) -> Column:
    """All keys that a rule with such numbers of host labels and path characters could have to fit."""
    have = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1

    def of_host(n: Column) -> Column:
        # n labels of the host; a shorter host is taken by another n
        key = lambda m: F.when((have >= n) & (host != "") & (F.length(path) >= m), F.concat(F.call_function("substring_index", host, F.lit("."), -n), F.substring(path, F.lit(1), m)))
        return F.transform(F.array(*[F.lit(m) for m in prefixes]), key)

    return F.filter(F.flatten(F.transform(F.array(*[F.lit(n) for n in labels]), of_host)), lambda k: k.isNotNull())


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict; rules are (host, path, "block" or "allow").

    A rule fits its host and all subdomains where the path starts with the rule's; of those that fit the longest rule
    (host and path together) wins, block before allow where one is listed twice, else the verdict is default and rule
    is null. A null url, or one without ://, has an empty host and path, which no rule fits. Rows are judged one by one:
    repeated rows and other columns pass through; columns named host, path, rule or verdict are replaced. An empty table
    gives an empty one.
    """
    keys = {v: sorted({h.translate(str.maketrans(UPPER, LOWER)) + p for h, p, x in rules if x == v}) for v in ("block", "allow")}
    labels = sorted({h.count(".") + 1 for h, _, _ in rules})
    prefixes = sorted({len(p) for _, p, _ in rules})
    parsed = pages.withColumns({"host": host_of(F.col(url_col).cast("string")), "path": path_of(F.col(url_col).cast("string"))})
    if not rules:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    best, tries = free_names(parsed, "best", "tries")
    tried = parsed.withColumn(tries, _candidates(F.col("host"), F.col("path"), labels, prefixes))
    universe = tried.select(F.explode(tries).alias("key"))
    n = universe.count()
    cascades = {v: Cascade(universe, k, n) for v, k in keys.items()}
    hit = lambda v: F.transform(F.filter(tries, cascades[v].has), lambda key: F.struct(F.length(key).alias("n"), F.lit(v == "block").alias("first"), key.alias("rule"), F.lit(v).alias("verdict")))
    marked = tried.withColumn(best, F.array_max(F.concat(hit("block"), hit("allow"))))
    return marked.withColumns({"rule": F.col(f"{best}.rule"), "verdict": F.coalesce(F.col(f"{best}.verdict"), F.lit(default))}).drop(best, tries)
