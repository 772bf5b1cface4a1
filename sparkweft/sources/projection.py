"""The domain's relations read off the test tables: one SQL text for both engines.

Rules are deterministic in the keys and take every row of their tables. There are REPOS repositories: an order's commit is of one
of them, and part p is a file there if a line of the order names it. All neighbouring lines of an order are imports and calls, each
file imports a foundation of its repository, and all lines touch a resource. Files whose part's key ends in 9 are not in the graph, so
some claims hit paths that it does not know. A user works in one repository, on a window of files that overlaps with the next users',
now and then on a foundation; a user's events of a day are one change. Claims of the last IN_FLIGHT days are in flight, earlier ones are released.
Analysis lost facts in some repositories only, as one lossy file in flight decides about its whole repository.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

REPOS, FOUNDATIONS = 11, 25
IN_FLIGHT = "2024-01-24"


def path_sql(k: str, r: str) -> str:
    """The path of file k of repository r; every 37th is a lock file."""
    return f"(CASE WHEN {k} % 13 = 0 THEN 'tests/m' ELSE 'src/m' END || {r} || '/d' || ({k} % 5) || '/p' || {k} || CASE WHEN {k} % 37 = 5 THEN '.lock' WHEN {k} % 3 = 0 THEN '.py' WHEN {k} % 3 = 1 THEN '.ts' ELSE '.go' END)"


def name_sql(k: str, r: str, name: str) -> str:
    return f"(CASE WHEN {k} % 50 = 0 THEN 'map' WHEN {k} % 50 = 1 THEN '__init__' WHEN {k} % 50 = 3 THEN 'pop' ELSE replace({name}, ' ', '_') || '_' || ({k} % 40) || '_' || {r} END)"


_LINE = f"(SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k, l_suppkey AS s, l_returnflag AS flag, l_orderkey % {REPOS} AS r FROM lineitem)"
_KNOWN = f"(SELECT DISTINCT k, r, p_name, p_size FROM {_LINE} l JOIN part ON p_partkey = k WHERE k % 10 <> 9)"
_NEXT = f"FROM {_LINE} a JOIN {_LINE} b ON a.o = b.o AND a.n + 1 = b.n"
_BASE = f"(1 + k % {FOUNDATIONS})"
_FLAW = "CASE WHEN {0} % 10 = 0 THEN 'ambiguous' WHEN {0} % 11 = 0 THEN 'unresolved' END"
#: One row for each event: its change, agent and file.
_EVENT = f"""(SELECT event_id, ts, user_id, event_type, value, r, k, {path_sql("k", "r")} AS path, 'ag' || (user_id % 13) AS agent,
    CASE WHEN user_id % 17 = 5 THEN 'BR-topic/' WHEN user_id % 17 = 6 THEN 'BR-release/' ELSE 'PR-' END || user_id || '-' || extract(day FROM ts) AS change_id
  FROM (SELECT *, user_id % {REPOS} AS r, CASE WHEN x % 10 = 0 THEN 1 + cast(floor(x / 10) AS bigint) ELSE cast(floor(user_id / {REPOS}) AS bigint) * 130 + x * 2 END AS k
    FROM (SELECT *, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) AS x FROM events) e) f)"""
_CLAIMS = f"""SELECT event_id AS claim_id, 'r' || r AS repo, path, change_id, agent, claimed_at, CASE WHEN NOT live THEN 'released' WHEN rn = 1 THEN 'active' ELSE 'waiting' END AS state, lo, hi, base_hash, is_draft FROM (
    SELECT *, row_number() OVER (PARTITION BY path, live ORDER BY claimed_at, event_id) AS rn FROM (
      SELECT event_id, r, path, change_id, agent, ts AS claimed_at, cast(ts AS date) >= DATE '{IN_FLIGHT}' AS live, cast(event_id % 110 as bigint) AS lo, cast(event_id % 110 + 1 + event_id % 7 as bigint) AS hi,
        'h' || ((k + CASE WHEN event_id % 4 = 0 THEN 1 ELSE 0 END) % 7) AS base_hash, user_id % 9 = 0 AS is_draft, row_number() OVER (PARTITION BY path, change_id ORDER BY ts, event_id) AS first_one
      FROM {_EVENT} e) f WHERE first_one = 1) g"""



def _go(k: str, r: str) -> str:
    """A Go file: packages of a few files, so that their number grows with the table; directories nest, and some short ones are endings of others."""
    return f"('internal/g' || cast(floor({k} / 7) as bigint) || '/' || CASE WHEN {k} % 4 = 0 THEN 'sub/' ELSE '' END || 'm' || {r} || '/f' || {k} || CASE WHEN {k} % 7 = 0 THEN '_test.go' ELSE '.go' END)"


def _cs(k: str, r: str) -> str:
    """A C# file: a third lie in directories of one name in several projects, some in tests."""
    return f"(CASE WHEN {k} % 3 = 0 THEN 'P' || {r} || '/Old/G' || cast(floor({k} / 30) as bigint) WHEN {k} % 11 = 0 THEN 'Acme.M' || {r} || '/Tests/G' || cast(floor({k} / 10) as bigint) ELSE 'Acme.M' || {r} || '/G' || cast(floor({k} / 10) as bigint) END || '/T' || {k} || '.cs')"


def _ws(k: str, r: str) -> str:
    """A file of a workspace package, below src or not, some an index of their directory, some in a package with a longer name."""
    return f"('packages/m' || {r} || '/p' || ({k} % 50) || CASE WHEN {k} % 50 % 3 = 0 AND {k} % 4 = 1 THEN '/deep' ELSE '' END || CASE WHEN {k} % 2 = 0 THEN '/src/' ELSE '/' END || 'f' || ({k} % 700) || CASE {k} % 5 WHEN 0 THEN '/index.ts' WHEN 1 THEN '.tsx' ELSE '.ts' END)"


_NL = "chr(10)"
_PARTS = "(SELECT p_partkey AS k, p_partkey * 3 + 1 AS j FROM part)"
_GO = f"CASE WHEN k IN (2, 52) THEN 'sub/m' || r || '/f' || k || '.go' ELSE {_go('k', 'r')} END"

#: Changes of lines of an order, in repositories of twenty orders with a hundred files each; the repository's graph is that of baseline b0.
_CHANGED = """(SELECT *, CASE WHEN f % 10 = 3 THEN '.md' ELSE '.py' END AS ending, CASE WHEN v = 5 THEN (f * 7 + 11) % 100 ELSE cast(floor(f / 3) as bigint) END AS j FROM (
    SELECT CASE WHEN o % 9 = 0 THEN 'BR-' ELSE 'PR-' END || o AS change_id, cast(floor(o / 20) as bigint) AS w, CASE WHEN o % 8 = 7 THEN 'b1' ELSE 'b0' END AS base, k % 100 AS f, min((o + n) % 6) AS v, min((o * 3 + n) % 5) AS s, max(CASE WHEN (o + k) % 97 = 0 THEN 1 ELSE 0 END) AS lost
    FROM (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey AS k FROM lineitem) l GROUP BY ALL) c)"""
_BASED = """(SELECT w, f, base, ending, cast(floor(f / 3) as bigint) AS j, f % 5 AS s FROM (SELECT DISTINCT w, f, ending FROM {0} c) d CROSS JOIN (SELECT 'b0' AS base UNION ALL SELECT 'b1') two)""".format(_CHANGED)


def _module(k: str, sep: str) -> str:
    return f"'w' || w || '{sep}d' || ({k} % 7) || '{sep}f' || {k}"


def _python(run: str, make: str) -> str:
    """A file that imports module j, defines C.make and mostly a function run, and calls what it imported in the way s."""
    call = f"CASE s WHEN 0 THEN 'go(1, 2)' WHEN 1 THEN 'go(1, b=2)' WHEN 2 THEN 'go(*[1])' WHEN 3 THEN {_module('j', '.')} || '.run(1)' ELSE 'K.make(1, 2)' END"
    return f"""'from ' || {_module("j", ".")} || ' import run as go, C as K' || chr(10) || 'import ' || {_module("j", ".")} || chr(10) || 'class C:' || chr(10) || '    def make(self, a' || {make} || '): pass' || chr(10) || {run} || chr(10) || '    ' || {call} || chr(10)"""


_RUN_BASE = "CASE WHEN base = 'b1' AND f % 2 = 0 THEN 'def run(a, b):' ELSE 'def run(a, b=1):' END"
_RUN_HEAD = f"CASE v WHEN 1 THEN 'def run(a, b, c):' WHEN 2 THEN 'if True:' WHEN 3 THEN 'def run(a, *, mode):' WHEN 4 THEN 'def run(a, b=1):' ELSE {_RUN_BASE} END"
_CHANGED_PATH = f"{_module('f', '/')} || ending"

RELATIONS = {
    "changed_file": f"SELECT 'w' || w AS repo, change_id, base, {_CHANGED_PATH} AS path, f, j, v, s, lost, CASE WHEN v = 2 AND f % 20 = 0 THEN cast(NULL as varchar(1)) WHEN lost = 1 THEN 'def (' ELSE {_python(_RUN_HEAD, "CASE WHEN v = 4 THEN ', b' ELSE '' END")} END AS text FROM {_CHANGED} c",
    "based_file": f"SELECT 'w' || w AS repo, base, {_CHANGED_PATH} AS path, f, j, s, {_python(_RUN_BASE, chr(39) * 2)} AS text FROM {_BASED} b",
    "touch": f"""SELECT o AS commit_id, o_orderdate AS ts, path FROM (SELECT o, {path_sql("k", "r")} AS path FROM {_LINE} l UNION SELECT o, {path_sql(_BASE, "r")} FROM {_LINE} l WHERE n % 2 = 0) t JOIN orders ON o = o_orderkey""",
    "file_node": f"SELECT {path_sql('k', 'r')} AS path, CASE k % 3 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'go' END AS language, p_size * 20 AS loc, p_size % 17 = 0 AS generated, CASE WHEN r % 3 = 0 AND k % 97 = 0 THEN 'incomplete' WHEN r % 3 = 0 AND k % 89 = 0 THEN 'failed' WHEN k % 83 = 0 THEN 'ambiguous' END AS analysis_status FROM {_KNOWN} f",
    "symbol_node": f"""SELECT {path_sql("k", "r")} AS path, {name_sql("k", "r", "p_name")} || t AS name, CASE WHEN k % 4 = 0 THEN 'class' ELSE 'def' END AS kind, cast(CASE WHEN t = '' THEN 1 ELSE 13 END + p_size % 20 as bigint) AS start_line,
        cast(CASE WHEN t = '' THEN 12 ELSE 40 END + p_size % 20 as bigint) AS end_line, 'h' || (k % 7) AS content_hash FROM {_KNOWN} f CROSS JOIN (SELECT '' AS t UNION ALL SELECT '_b') two""",
    "import_edge": f"""SELECT DISTINCT {path_sql("a.k", "a.r")} AS src, {path_sql("b.k", "a.r")} AS dst, {_FLAW.format("a.o")} AS reference_status {_NEXT} WHERE a.k <> b.k
        UNION SELECT {path_sql("k", "r")}, {path_sql(_BASE, "r")}, cast(NULL as varchar(10)) FROM {_LINE} l WHERE k <> {_BASE}""",
    "call_edge": f"SELECT DISTINCT {path_sql('a.k', 'a.r')} AS src, {name_sql('b.k', 'a.r', 'p_name')} AS dst, CASE WHEN a.o % 15 = 0 THEN 'ambiguous' END AS reference_status {_NEXT} JOIN part ON p_partkey = b.k",
    "resource_edge": f"SELECT DISTINCT {path_sql('k', 'r')} AS src, 'table::t' || ((s * 7 + n) * 2 + o % 2) || '_' || r AS dst, CASE flag WHEN 'R' THEN 'alters' WHEN 'A' THEN 'queries' ELSE 'reads_config' END AS kind, cast(NULL as varchar(10)) AS reference_status FROM {_LINE} l",
    "claim": f"SELECT * FROM ({_CLAIMS}) h WHERE state <> 'released'",
    "claim_history": _CLAIMS,
    "event_log": f"SELECT event_id, ts AS occurred_at, agent, 'ag' || ((user_id + event_id) % 13) AS counterparty, change_id, CASE event_type WHEN 'signup' THEN 'landed' WHEN 'view' THEN 'collision_held' WHEN 'click' THEN 'warned' WHEN 'purchase' THEN 'pr_failing' ELSE 'pushed' END AS kind, path, 'acct' || (user_id % 6) AS account, value FROM {_EVENT} e",
    "source_file": f"""SELECT 'pkg' || (k % 7) || '/m' || k || '.py' AS path, CASE WHEN k % 101 = 7 THEN 'def (' ELSE 'from pkg' || (j % 7) || ' import m' || j || {_NL} || 'import os' || {_NL} || 'K = os.getenv("KEY_W' || (k % 50) || '")' || {_NL}
          || 'def f' || k || '(a, b=1):' || {_NL} || '    return f' || j || '(a)' || {_NL} || 'class C' || k || '(Base' || (k % 3) || '):' || {_NL} || '    q = "SELECT x FROM t' || k || ' JOIN t' || j || '"' || {_NL} END AS text FROM {_PARTS} p
        UNION ALL SELECT 'db/t' || k || '.sql', 'CREATE TABLE t' || k || ' (id int);' || CASE WHEN k % 10 = 0 THEN ' CREATE TABLE t' || (k + 1) || ' (id int);' WHEN k % 5 = 1 THEN ' ALTER TABLE t' || (k + 1) || ' ADD c int;' ELSE '' END FROM {_PARTS} p
        UNION ALL SELECT 'conf/e' || k || '.env', 'KEY_W' || k || '=1' || CASE WHEN k % 9 = 0 THEN {_NL} || 'KEY_W' || (k + 1) || '=2' ELSE '' END FROM {_PARTS} p
        UNION ALL SELECT 'web/c' || page_id || '.ts', 'export function g' || page_id || '() {{ return fetch(`/api/items/' || (page_id % 20) || '/$' || '{{x}}`) }}' FROM pages
        UNION ALL SELECT DISTINCT 'srv/' || t || (page_id % 30) || '.py', '@app.get("/api/items/' || (page_id % 30) || '/{{id}}")' || {_NL} || 'def h' || (page_id % 30) || '(id):' || {_NL} || '    return 1' || {_NL} FROM pages CROSS JOIN (SELECT 's' AS t UNION ALL SELECT 'z') two WHERE t = 's' OR page_id % 30 % 4 = 0""",
    "install": "SELECT 'a' || c_custkey AS account, o_first + INTERVAL 1 DAY * (c_custkey % 9 - 4) AS created_at, c_custkey % 7 = 0 AS revoked FROM customer JOIN (SELECT o_custkey, min(o_orderdate) AS o_first FROM orders GROUP BY o_custkey) f ON o_custkey = c_custkey UNION ALL SELECT 'a' || c_custkey, TIMESTAMP '1997-01-01 00:00:00', c_custkey % 14 = 0 FROM customer WHERE c_custkey % 3 = 0",
    "activation": "SELECT 'a' || o_custkey AS account, 'r' || (o_orderkey % 3) AS repo, min(o_orderdate) + INTERVAL 1 DAY * (o_custkey % 300) AS activated_at FROM orders WHERE o_custkey % 10 <> 4 GROUP BY o_custkey, o_orderkey % 3",
    "tombstone": "SELECT 'a' || c_custkey AS account, 'r' || n AS repo FROM customer CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1 UNION ALL SELECT 2) three WHERE (c_custkey + n) % 6 = 0 OR c_custkey % 11 = 5",
    "act": """SELECT 'a' || o_custkey AS account, 'r' || (o_orderkey % 3) AS repo, CASE (o_orderkey + l_linenumber) % 5 WHEN 0 THEN 'claim' WHEN 1 THEN 'warn_issued' WHEN 2 THEN 'collision_held' WHEN 3 THEN 'check_published' ELSE 'human_judgment' END AS kind,
        CASE WHEN o_orderkey % 7 = 0 THEN 'BR-' ELSE 'PR-' END || (o_orderkey % 50) AS change_id, o_orderdate + INTERVAL 1 HOUR * (l_linenumber * 11 + o_orderkey % 24) AS acted_at,
        CASE WHEN (o_orderkey + l_linenumber) % 5 = 4 THEN CASE WHEN l_partkey % 8 = 0 THEN 'none' ELSE 'judgment=' || CASE WHEN l_partkey % 2 = 0 THEN 'useful' ELSE 'too-late' END || CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE ' action=merged-first' END END
          ELSE CASE l_partkey % 6 WHEN 0 THEN 'clear' WHEN 1 THEN 'heads_up' WHEN 2 THEN 'wait_in_line' WHEN 3 THEN 'paused' WHEN 4 THEN 'odd' END END AS detail
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "own_account": "SELECT 'a' || c_custkey AS account FROM customer WHERE c_custkey % 25 = 1",
    "sql_file": """SELECT 'db/c' || k || '.sql' AS path, 'sql' AS language, '-- CREATE TABLE ghost (id int);' || chr(10) || 'CREATE TABLE IF NOT EXISTS app.t' || k || ' (id int, name_' || (k % 5) || ' varchar(10), price numeric(10, 2), PRIMARY KEY (id, price), CHECK (price > 0));'
          || CASE WHEN k % 4 = 0 THEN ' ALTER TABLE t' || (k + 1) || ' ADD COLUMN extra_' || (k % 3) || ' int, DROP COLUMN gone;' ELSE '' END AS text FROM (SELECT p_partkey AS k FROM part) p
        UNION ALL SELECT 'db/d' || p_partkey || '.sql', 'sql', 'create table t' || p_partkey || ' (id int)' FROM part WHERE p_partkey % 10 = 0
        UNION ALL SELECT 'app/q' || l_orderkey || '_' || l_linenumber || '.py', 'python', 'q = "SELECT a.id, b.price AS p, name_' || (l_partkey % 5) || ', count(*), max(a.price) FROM t' || l_partkey || ' a JOIN app.t' || (l_partkey * 3 + 1) || ' AS b ON a.id = b.id WHERE a.id IN (SELECT id FROM t' || l_suppkey || ' WHERE price > 1)"' || chr(10)
          || 'u = "UPDATE t' || l_partkey || ' SET price = 1, extra_' || (l_orderkey % 3) || ' = 2 WHERE id = 3"' FROM lineitem""",
    "go_file": f"SELECT {_GO} AS path FROM {_KNOWN} f",
    "go_import": f"""SELECT DISTINCT {_go("a.k", "a.r")} AS src, CASE b.o % 5 WHEN 0 THEN 'fmt' WHEN 1 THEN 'other.io/sub/m' || b.r WHEN 2 THEN 'other.io/zap' || b.k ELSE 'example.org/app/' || regexp_replace({_go("b.k", "b.r")}, '/[^/]*$', '') END AS module {_NEXT}""",
    "cs_file": f"SELECT {_cs('k', 'r')} AS path FROM {_KNOWN} f",
    "cs_import": f"""SELECT DISTINCT {_cs("a.k", "a.r")} AS src, CASE b.o % 5 WHEN 0 THEN 'System' WHEN 1 THEN 'Old.G' || cast(floor(b.k / 30) as bigint) WHEN 2 THEN 'Newtonsoft.J' || b.k ELSE replace(regexp_replace({_cs("b.k", "b.r")}, CASE WHEN b.o % 2 = 0 THEN '/[^/]*$' ELSE '[.]cs$' END, ''), '/', '.') END AS module {_NEXT}""",
    "ws_package": f"SELECT DISTINCT '@s' || r || '/p' || (k % 50) || t AS name, 'packages/m' || r || '/p' || (k % 50) || t AS root FROM {_KNOWN} f CROSS JOIN (SELECT '' AS t UNION ALL SELECT '/deep') two WHERE t = '' OR k % 50 % 3 = 0",
    "ws_file": f"SELECT DISTINCT {_ws('k', 'r')} AS path FROM {_KNOWN} f UNION SELECT 'packages/m' || r || '/p' || (k % 50) || CASE WHEN k % 2 = 0 THEN '/src' ELSE '' END || '/index.ts' FROM {_KNOWN} f WHERE k % 50 < 40",
    "ws_import": f"""SELECT DISTINCT {_ws("a.k", "a.r")} AS src, CASE b.o % 6 WHEN 0 THEN '@babel/core' WHEN 1 THEN '@s' || b.r || '/p' || (b.k % 50) WHEN 2 THEN '@s' || b.r || '/p' || (b.k % 50) || '/none' || b.k
        ELSE '@s' || b.r || regexp_replace(replace(replace({_ws("b.k", "b.r")}, 'packages/m' || b.r, ''), '/src/', '/'), '(/index)?[.][a-z.]+$', '') END AS module {_NEXT}""",
}

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relation(spark: SparkSession, sf_dir: str, name: str, parts: int | None = None) -> DataFrame:
    """A relation by name, as a DataFrame over the Parquet tables of sf_dir, each dealt by its key to parts partitions first where that is given."""
    text = RELATIONS[name]
    used = [t for t in _TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    text = text.replace("{", "{{").replace("}", "}}")
    rows = {t: table(spark, sf_dir, t) for t in used}
    if parts:
        rows = {t: d.repartition(parts, d.columns[0]) for t, d in rows.items()}
    return spark.sql(re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text), **rows)


def with_relations(query: str) -> str:
    """The query with the relations it names before it, for the SQL engine."""
    used = [n for n in RELATIONS if re.search(rf"\b{n}\b", query)]
    head = ", ".join(f"{n} AS ({RELATIONS[n]})" for n in used)
    body = query.strip()
    if not head:
        return body
    if m := re.match(r"WITH (RECURSIVE )?", body, re.I):
        return f"WITH {m[1] or ''}{head}, {body[m.end():]}"
    return f"WITH {head} {body}"
