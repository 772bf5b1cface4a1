"""The opN_ queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweft.llm.chat_tree import prefix_trees, read_back
from sparkweft.llm.clustering import cluster
from sparkweft.llm.decontaminate import contaminated
from sparkweft.llm.minhash_dedup import near_duplicates
from sparkweft.llm.packing import pack, token_pieces
from sparkweft.llm.quality_classifier import fit_quality, score_quality
from sparkweft.llm.quality_rules import quality_rules
from sparkweft.llm.resampling import resample
from sparkweft.llm.secret_scan import ALLOWED, CLASSES, NARROW, WEIGHT, WINDOW, find_secrets, most_allowed, span_string
from sparkweft.llm.shared import read_table
from sparkweft.llm.sharding import MULTIPLIERS, ROUNDS, round_keys, sharded_digests
from sparkweft.llm.toxicity import fit_toxicity, score_toxicity
from sparkweft.llm.url_filter import filter_urls
from sparkweft.llm.warc import round_trip

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
CAPACITY = 4096
SHARDS, SEED = 16, 7


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read_table(spark, sf_dir, "pages").select("page_id", "url"), RULES).drop("url")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, read_table(spark, sf_dir, "labels")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(read_table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY)
    return pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), CAPACITY)


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, read_table(spark, sf_dir, "labels")))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=80)


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    awkward = F.lit("\\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), awkward.alias("text"))
    return read_back(*prefix_trees(rows.unionByName(extra)))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_string(F.filter("secrets", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), span_string(F.col("secrets")).alias("spans"),
    )


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharded_digests(read_table(spark, sf_dir, "documents"), SHARDS, SEED)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(read_table(spark, sf_dir, "embeddings"), k=40, rounds=5, seed=2, dims=64, scale=256)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), percent=25, min_words=20, n=2, buckets=10_000, seed=7)


UPPER_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

ORACLE_OP1 = rf"""
WITH parsed AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), {UPPER_LOWER}), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, h || p AS rule, v, length(h || p) AS n FROM parsed JOIN rules
  ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
best AS (SELECT page_id, arg_max(rule, n) AS rule, arg_max(v, n) AS v FROM fits GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parsed LEFT JOIN best USING (page_id)
"""

ORACLE_OP6 = rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
sh AS (SELECT doc_id, unnest(s) AS x FROM sets),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM pairs JOIN sets p ON p.doc_id = a JOIN sets q ON q.doc_id = b WHERE 100 * k >= 85 * (len(p.s) + len(q.s) - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS MATERIALIZED (
  WITH RECURSIVE r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.b FROM r JOIN both_ways e ON r.y = e.a) SELECT x, min(y) AS root FROM r GROUP BY x)
SELECT doc_id, len(s)::BIGINT AS n_shingles, root AS component_id, doc_id = root AS kept FROM sets JOIN reach ON x = doc_id
"""

ORACLE_OP8 = rf"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), {UPPER_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM texts),
sets AS (
  SELECT side, id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
sh AS (SELECT side, id, unnest(s) AS x, len(s) AS n FROM sets),
shared AS (
  SELECT d.id AS doc_id, b.id AS item_id, any_value(b.n) AS n, count(*) AS k FROM sh d JOIN sh b ON d.side = 0 AND b.side = 1 AND d.x = b.x GROUP BY d.id, b.id)
SELECT doc_id, item_id, n::BIGINT AS n_item_shingles, k AS n_shared FROM shared WHERE 100 * k >= 80 * n
"""

ORACLE_OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
per AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    sum(length(regexp_replace(text, '([\\#<])', '_\1', 'g')) + length(regexp_replace(role, '([\\#<:\n])', '_\1', 'g')) + 15) AS n
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, n::BIGINT AS formatted_chars FROM per
"""

ORACLE_OP2 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
n AS (SELECT page_id, h, max(page_id) OVER (PARTITION BY h) AS first, count(*) OVER (PARTITION BY h) AS n FROM p),
b AS (SELECT *, array_to_string(list_transform(string_split(sha1(h), ''), lambda c: (['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'])[strpos('0123456789abcdef', c)]), '') AS bits FROM n)
SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (16 * (substr(bits, 5 * i + 1, 1) = '1')::INT + 8 * (substr(bits, 5 * i + 2, 1) = '1')::INT
    + 4 * (substr(bits, 5 * i + 3, 1) = '1')::INT + 2 * (substr(bits, 5 * i + 4, 1) = '1')::INT + (substr(bits, 5 * i + 5, 1) = '1')::INT)::INT, 1)), '') AS payload_digest,
  CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n > 1 AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM b
"""


def _oracle_op10() -> str:
    either = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    assign = rf"""({"|".join(map(either, ("password", "passwd", "secret", "token", "api_?key")))})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
    kinds = [(0, assign), (1, "AKIA[A-Z0-9]+"), (2, "[0-9a-f]+"), (3, "[A-Za-z0-9+/_=-]{20,}")]
    found = " UNION ALL ".join(f"SELECT doc_id, {k} AS kind, regexp_extract_all(x, '{p}') AS f, string_split_regex(x, '{p}') AS g, {f"regexp_extract_all(x, '{p}', 2)" if not k else "[]::VARCHAR[]"} AS v FROM t" for k, p in kinds)
    allowed = " OR ".join(f"regexp_matches(str, '{p}')" for p in ALLOWED)
    bound = "CASE " + " ".join(f"WHEN regexp_matches(str, '{chars}') THEN {most_allowed(bits)}" for _, chars, bits in NARROW + CLASSES) + " END"
    names = "(['assign', 'access', 'hex', 'entropy'])[kind + 1]"
    said = f"{names} || ':' || start || ':' || stop"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents), m AS ({found}),
i AS (SELECT doc_id, kind, f, g, v, unnest(range(1, len(f) + 1)) AS i FROM m),
s AS (SELECT doc_id, kind, f[i] AS str, coalesce(list_sum(list_transform(g[1:i], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(f[1:i - 1], lambda q: length(q))), 0) AS start, v[i] AS v FROM i),
e AS (SELECT *, start + length(str) AS stop FROM s),
base AS (SELECT * FROM e WHERE (kind = 0 AND length(v) >= 6) OR (kind = 1 AND length(str) >= 20) OR (kind = 2 AND length(str) >= 24)),
cand AS (SELECT * FROM e WHERE kind = 3 AND regexp_matches(str, '[0-9]') AND regexp_matches(str, '[A-Za-z]') AND NOT ({allowed})
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = e.doc_id AND b.start < e.stop AND e.start < b.stop)),
w AS (SELECT doc_id, start, string_split(substr(str, j, {WINDOW}), '') AS w FROM (SELECT doc_id, start, str, unnest(range(1, length(str) - {WINDOW - 2})) AS j FROM cand)),
h AS (SELECT doc_id, start, min(list_sum(list_transform(list_distinct(w), lambda c: ({WEIGHT})[len(list_filter(w, lambda d: d = c)) + 1]))) AS least FROM w GROUP BY ALL),
every AS (SELECT doc_id, kind, start, stop FROM base UNION ALL SELECT doc_id, kind, start, stop FROM cand JOIN h USING (doc_id, start) WHERE least <= {bound}),
r AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS k, count(*) FILTER (WHERE kind = 2) AS x,
  coalesce(string_agg(CASE WHEN kind < 3 THEN {said} END, ',' ORDER BY start, kind), '') AS b, string_agg({said}, ',' ORDER BY start, kind) AS spans FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(x, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN r USING (doc_id)
"""


def crc_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes, byte by byte over the usual table, whose entries are CRCs of single bytes without their frame."""
    table = [zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFFFFFFFF for i in range(256)]
    step = f"xor(c >> 8, ({table}::UBIGINT[])[(xor(c & 255, y) + 1)::BIGINT])"
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::UBIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, {digits}), lambda c, y: {step}), 4294967295::UBIGINT)::BIGINT"


def _oracle_op11() -> str:
    inner = "SELECT i, n, a, b, x % a AS h0, x // a AS h1 FROM walk WHERE x >= n OR NOT walked"
    for r, key in enumerate(round_keys(SEED)):
        mine, other, side = f"h{r % 2}", f"h{1 - r % 2}", "ab"[r % 2]
        first = f"(({other} + {key}) & 4294967295) * {MULTIPLIERS[0]} & 4294967295"
        inner = f"SELECT i, n, a, b, {other}, {mine}, xor(m, m >> 15) * {MULTIPLIERS[1]} & 4294967295 AS m FROM (SELECT *, {first} AS m FROM ({inner}))"
        inner = f"SELECT i, n, a, b, {other}, ({mine} + xor(m, m >> 13) % {side}) % {side} AS {mine} FROM ({inner})"
    assert ROUNDS == r + 1
    return f"""
WITH RECURSIVE t AS (SELECT doc_id, coalesce(text, '') AS x, (row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1)::UBIGINT AS i, count(*) OVER () AS n FROM documents),
sides AS (SELECT n, a, ((n + a - 1) // a)::UBIGINT AS b FROM (SELECT any_value(n)::UBIGINT AS n, ceil(sqrt(any_value(n)))::UBIGINT AS a FROM t)),
walk(i, n, a, b, x, walked) AS (SELECT i, sides.n, a, b, i, false FROM t, sides UNION ALL SELECT i, n, a, b, h0 + a * h1, true FROM ({inner}))
SELECT doc_id, octet_length(encode(t.x))::BIGINT + 1 AS size, {crc_sql("t.x")} AS text_crc32, 'rows' AS law, (w.x % {SHARDS})::INT AS shard, (w.x // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard
FROM t JOIN walk w ON w.i = t.i AND w.walked AND w.x < w.n
"""


def _oracle_op12(k: int = 40, rounds: int = 5, seed: int = 2, dims: int = 64) -> str:
    near = lambda r: f"""d{r} AS (SELECT id, j, sum((x - c) * (x - c))::BIGINT AS d FROM v JOIN c{r} USING (i) GROUP BY ALL),
a{r} AS (SELECT id, arg_min(j, (d, j)) AS j, min(d) AS d FROM d{r} GROUP BY id)"""  # noqa: E731
    move = lambda r: f"""s{r} AS (SELECT a.j, i, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM a{r} a JOIN v USING (id) GROUP BY ALL),
c{r + 1} AS (SELECT j, i, CASE WHEN n IS NULL THEN c ELSE (s - ((s % n) + n) % n) // n END AS c FROM c{r} LEFT JOIN s{r} USING (j, i))"""  # noqa: E731
    steps = ",\n".join(f"{near(r)},\n{move(r)}" for r in range(rounds))
    return f"""
WITH kept AS (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, unnest(range(1, {dims + 1})) AS i, unnest(x) AS x FROM kept),
first AS (SELECT id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id) NULLS LAST, x) - 1 AS j FROM kept),
c0 AS (SELECT j, i, x AS c FROM first JOIN v USING (id) WHERE j < {k}),
{steps},
{near(rounds)},
names AS (SELECT j, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY j)
SELECT vec_id, j::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY j)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN kept USING (id) JOIN names USING (j)
"""


def _oracle_op13() -> str:
    words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), {UPPER_LOWER}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS id, 0 AS side, doc_id, {words("text")} AS w FROM documents UNION ALL SELECT 0, 1, NULL, {words("text")} FROM benchmark),
f AS MATERIALIZED (SELECT id, side, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM texts),
codes AS MATERIALIZED (SELECT f, {crc_sql("f")} % 10000 AS b FROM (SELECT DISTINCT f FROM f)),
n AS (SELECT b, count(*) FILTER (WHERE side = 0) AS s, count(*) FILTER (WHERE side = 1) AS t FROM f JOIN codes USING (f) GROUP BY b),
total AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM n),
gain AS (SELECT b, floor(1000 * ln(((n.t + 1) * (total.s + 10000))::DOUBLE / ((n.s + 1) * (total.t + 10000))::DOUBLE))::BIGINT AS g FROM n, total),
sums AS (SELECT id, count(*) AS n, sum(g)::BIGINT AS s FROM f JOIN codes USING (f) JOIN gain USING (b) WHERE side = 0 GROUP BY id),
w AS (SELECT id, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce((s - ((s % n) + n) % n) // n, 0)::BIGINT AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM texts LEFT JOIN sums USING (id) WHERE side = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w),
ranked AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id, n_features) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (id)
"""


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_decontaminate": op8_decontaminate,
    "op9_chat_tree": op9_chat_tree,
    "op10_secret_scan": op10_secret_scan,
    "op11_sharding": op11_sharding,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_importance_resampling": op13_importance_resampling,
}
ORACLES = {"op1_url_filter": ORACLE_OP1, "op2_warc": ORACLE_OP2, "op6_minhash_dedup": ORACLE_OP6, "op8_decontaminate": ORACLE_OP8, "op9_chat_tree": ORACLE_OP9, "op10_secret_scan": _oracle_op10()} | {
    "op11_sharding": _oracle_op11(), "op12_centroid_clustering": _oracle_op12(), "op13_importance_resampling": _oracle_op13(),
}
