"""Extractors: one file in, rows out. A file becomes nodes and edges of the code graph, and mentions of contracts.

A mention is (path, substrate, role, contract): a file defines a contract or uses it. Contracts that are only meaningful when
somebody defines them (tables, config keys, API types, jobs) are linked in a relational second pass: uses are joined with
the known definers, several definers make a contract ambiguous, and where the first pass lost a file all uses are marked incomplete.
"""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.functions import vocabulary as v

NODE = "path string, kind string, name string, start_line int, end_line int, param_names array<string>, kwonly_names array<string>, required_arity int, optional_arity int, has_varargs boolean, has_kwargs boolean, shape_fingerprint string"
EDGE = "src string, kind string, dst string, probe string"
MENTION = "path string, substrate string, role string, contract string"

# ---- Python ------------------------------------------------------------------------------------------------------


def shape_of(args: ast.arguments) -> dict:
    """A signature's names, arities and flags, with a short hash of them."""
    names = [a.arg for a in (*args.posonlyargs, *args.args)]
    kwonly = [a.arg for a in args.kwonlyargs]
    required = len(names) - len(args.defaults)
    out = {"param_names": names, "kwonly_names": kwonly, "required_arity": required, "optional_arity": len(args.defaults), "has_varargs": args.vararg is not None, "has_kwargs": args.kwarg is not None}
    need = [k.arg for k, d in zip(args.kwonlyargs, args.kw_defaults, strict=True) if d is None]
    out["shape_fingerprint"] = hashlib.sha1(json.dumps([names, required, sorted(kwonly), sorted(need), out["has_varargs"], out["has_kwargs"]]).encode()).hexdigest()[:12]
    return out


def _tail(node: ast.expr) -> str | None:
    if isinstance(node, ast.Call):
        node = node.func
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else None


def python_file(path: str, text: str) -> tuple[list[dict], list[tuple]]:
    """Nodes and edges of a Python file: definitions with their spans (decorators included), calls, bases, bare decorators, imports."""
    tree = ast.parse(text)
    nodes, edges = [], []
    for n in ast.walk(tree):
        if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            first = min([n.lineno, *(d.lineno for d in n.decorator_list)])
            kind = "class" if isinstance(n, ast.ClassDef) else "def"
            nodes.append({"path": path, "kind": kind, "name": n.name, "start_line": first, "end_line": n.end_lineno} | (shape_of(n.args) if kind == "def" else {}))
            edges.append((path, "contains", n.name, None))
            used = [d for d in n.decorator_list if not isinstance(d, ast.Call)] + (n.bases if kind == "class" else [])
            edges += [(path, "calls", name, None) for u in used if (name := _tail(u))]
        elif isinstance(n, ast.Call):
            if name := _tail(n):
                edges.append((path, "calls", name, None))
        elif isinstance(n, ast.Import):
            edges += [(path, "imports", a.name, None) for a in n.names]
        elif isinstance(n, ast.ImportFrom):
            base = "." * n.level + (n.module or "")
            if n.module:
                edges.append((path, "imports", base, None))
            edges += [(path, "imports", base + ("" if base.endswith(".") else ".") + a.name, "member") for a in n.names if a.name != "*"]
    return nodes, edges


# ---- other languages: definitions, calls and imports by pattern ----------------------------------------------------

# What a definition, a class and an import look like.
SYNTAX = {
    "javascript": (r"(?:function\s*\*?\s+([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>)", r"\bclass\s+([A-Za-z_$][\w$]*)", r"""(?:from\s+|require\(\s*|import\(\s*|import\s+)["']([^"']+)["']"""),
    "go": (r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)", r'^\s*(?:import\s+)?(?:[\w.]+\s+)?"([^"\s]+)"\s*$'),
    "java": (r"^\s+(?:[\w<>\[\],.]+\s+)+([a-z]\w*)\s*\([^;]*\)\s*(?:throws [\w, .]+)?\{", r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)", r"^import\s+(?:static\s+)?([\w.]+)\s*;"),
    "ruby": (r"^\s*def\s+(?:self\.)?([a-z_]\w*[?!]?)", r"^\s*(?:class|module)\s+([A-Z][\w:]*)", r"""^\s*require(?:_relative)?\s+["']([^"']+)["']"""),
    "php": (r"function\s+&?([A-Za-z_]\w*)\s*\(", r"^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+([A-Za-z_]\w*)", r"""^use\s+([\w\\]+)|(?:require|include)(?:_once)?\s*\(?["']([^"']+)["']"""),
    "csharp": (r"^\s+(?:(?:public|private|protected|internal|static|async|override|virtual)\s+)+[\w<>\[\],.?]+\s+([A-Z]\w*)\s*\(", r"\b(?:class|interface|struct|record)\s+([A-Z]\w*)", r"^\s*using\s+([\w.]+)\s*;"),
    "rust": (r"\bfn\s+([a-z_]\w*)", r"\b(?:struct|enum|trait)\s+([A-Z]\w*)", r"^\s*(?:pub\s+)?(?:use|mod)\s+([\w:]+)"),
    "c": (r"^[A-Za-z_][\w\s*]*?\b([A-Za-z_]\w*)\s*\([^;]*\)\s*\{", r"\b(?:struct|class|enum)\s+([A-Za-z_]\w*)\s*[{:]", r'^\s*#\s*include\s+"([^"]+)"'),
    "kotlin": (r"\bfun\s+(?:<[^>]+>\s*)?(?:[\w.]+\.)?([a-z]\w*)\s*\(", r"\b(?:class|interface|object)\s+([A-Z]\w*)", r"^import\s+([\w.]+)"),
    "swift": (r"\bfunc\s+([a-z]\w*)", r"\b(?:class|struct|protocol|enum|actor)\s+([A-Z]\w*)", r"^import\s+(\w+)"),
    "dart": (r"^\s*(?:[\w<>?]+\s+)+([a-z]\w*)\s*\([^;]*\)\s*(?:async\s*)?\{", r"\b(?:class|mixin|enum)\s+([A-Z]\w*)", r"""^import\s+["']([^"']+)["']"""),
    "elixir": (r"^\s*defp?\s+([a-z_]\w*[?!]?)", r"^\s*defmodule\s+([A-Z][\w.]*)", r"^\s*(?:alias|import|use)\s+([A-Z][\w.]*)"),
    "html": (r"(?!)", r"(?!)", r"""<(?:script|link|img|source)\b[^>]*?\b(?:src|href)\s*=\s*["'](?![a-z]+:|//|#|data:)([^"'?#]+)"""),
    "css": (r"(?!)", r"(?!)", r"""@(?:import|use|forward)\s+(?:url\()?["'](?![a-z]+:|//)([^"']+)|composes:[^;]*?from\s+["']([^"']+)"""),
}
ALIKE = {"typescript": "javascript", "vue": "javascript", "svelte": "javascript", "astro": "javascript", "cpp": "c", "scss": "css", "sass": "css", "less": "css"}
CALL = re.compile(r"(?<![\w$])([A-Za-z_$][\w$]*[?!]?)\s*\(")
KEYWORDS = frozenset("if for while switch catch return function func fn def class new sizeof typeof await async super this elif else match when do in not and or print with use require import".split())


def strip_comments(text: str, language: str) -> str:
    """Comments become blanks, line breaks stay, so line numbers hold."""
    blank = lambda m: re.sub(r"[^\n]", " ", m[0])
    if language in ("ruby", "elixir"):
        return re.sub(r"(?m)^\s*#[^\n]*", blank, text)
    if language == "html":
        return re.sub(r"(?s)<!--.*?-->", blank, text)
    return re.sub(r"(?s)/\*.*?\*/|(?m:(?<![:\"'])//[^\n]*$)", blank, text)


def pattern_file(path: str, text: str, language: str) -> tuple[list[dict], list[tuple]]:
    """Nodes and edges by the language's patterns; a definition ends where the next one starts."""
    language = ALIKE.get(language, language)
    if language not in SYNTAX:
        return [], []
    text = strip_comments(text, language)
    starts, nodes, edges = [], [], []
    for kind, pattern in zip(("def", "class"), SYNTAX[language][:2], strict=True):
        for m in re.finditer(pattern, text, re.M):
            starts.append((text.count("\n", 0, m.start()) + 1, kind, next(g for g in m.groups() if g)))
    starts.sort()
    last = text.count("\n") + 1
    for (line, kind, name), after in zip(starts, [*(s[0] for s in starts[1:]), last + 1], strict=False):  # none where nothing is defined
        if name not in KEYWORDS:
            nodes.append({"path": path, "kind": kind, "name": name, "start_line": line, "end_line": max(line, after - 1)})
            edges.append((path, "contains", name, None))
    edges += [(path, "imports", next(g for g in m.groups() if g), None) for m in re.finditer(SYNTAX[language][2], text, re.M)]
    if language not in ("html", "css"):
        defined = {(n["start_line"], n["name"]) for n in nodes}
        for m in CALL.finditer(text):
            if m[1] not in KEYWORDS and (text.count("\n", 0, m.start()) + 1, m[1]) not in defined:
                edges.append((path, "calls", m[1], None))
    return nodes, list(dict.fromkeys(edges))


# ---- contracts ---------------------------------------------------------------------------------------------------

NAME = r"[\"'`\[]?(?:\w+[\"'`\]]?\.[\"'`\[]?)*(\w+)"
#: Fixed values: (substrate, role, languages, pattern); the first group that matches is the contract.
CONTRACTS = [
    ("table", "creates", ("sql",), rf"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?{NAME}"),
    ("table", "defines", ("sql",), rf"(?i)\balter\s+table\s+(?:if\s+exists\s+)?(?:only\s+)?{NAME}"),
    ("table", "defines", ("sql",), rf"(?i)\bdrop\s+table\s+(?:if\s+exists\s+)?{NAME}"),
    ("table", "defines", ("sql",), rf"(?i)\bcreate\s+(?:unique\s+)?(?:index|trigger)\b[^;]*?\bon\s+{NAME}"),
    ("table", "uses", (), rf"\b(?:INSERT\s+INTO|insert\s+into|UPDATE|update|DELETE\s+FROM|delete\s+from)\s+{NAME}"),
    ("table", "uses", ("python",), r"__tablename__\s*=\s*[\"'](\w+)|\bTable\(\s*[\"'](\w+)|db_table\s*=\s*[\"'](\w+)"),
    ("table", "uses", ("java", "kotlin"), r"@Table\(\s*name\s*=\s*\"(\w+)"), ("table", "uses", ("ruby",), r"self\.table_name\s*=\s*[\"'](\w+)|create_table\s+:(\w+)"),
    ("table", "uses", ("typescript",), r"@Entity\(\s*[\"'](\w+)"), ("table", "uses", ("javascript", "typescript"), r"knex\(\s*[\"'](\w+)|\.createTable\(\s*[\"'](\w+)"), ("table", "uses", ("elixir",), r"schema\s+\"(\w+)\""),
    ("config", "uses", (), r"(?:os\.environ(?:\.get)?[\[(]|os\.getenv\(|getenv\(|process\.env[.\[]|ENV\[|ENV\.fetch\(|System\.getenv\(|env::var\(|os\.Getenv\()\s*[\"']?([A-Z][A-Z0-9_]{2,})"),
    ("graphql", "defines", ("graphql",), r"(?m)^(?:type|interface|enum|input|union|scalar)\s+([A-Z]\w*)"), ("graphql", "uses", ("graphql",), r"(?m)^extend\s+(?:type|interface|input)\s+([A-Z]\w*)"),
    ("graphql", "uses", ("javascript", "typescript", "python", "go"), r"\b(?:fragment\s+\w+\s+on|\.\.\.\s*on)\s+([A-Z]\w*)"),
    ("proto", "defines", ("protobuf",), r"(?m)^\s*(?:message|service|enum)\s+([A-Z]\w*)"), ("proto", "uses", ("python", "go", "java", "typescript", "javascript"), r"\b([A-Z]\w*?)(?:Client|Server|Stub|Servicer|Handler)\b"),
    ("terraform", "defines", ("terraform",), r"(?m)^(?:resource|data)\s+\"(\w+\"\s+\"\w+)\""), ("terraform", "uses", ("terraform",), r"(?<![\w.\"])(?:data\.)?((?:aws|google|azurerm|kubernetes|random|null)_\w+\.\w+)"),
    ("tauri", "defines", ("rust",), r"#\[(?:tauri::)?command[^\]]*\]\s*(?:pub\s+)?(?:async\s+)?fn\s+(\w+)"), ("tauri", "uses", ("javascript", "typescript", "vue", "svelte"), r"\binvoke(?:<[^>]*>)?\(\s*[\"'](\w+)"),
    ("job", "defines", ("python",), r"@(?:\w+\.)?(?:shared_)?task(?:\([^)]*\))?\s*\n\s*def\s+(\w+)"), ("job", "uses", ("python",), r"\bsend_task\(\s*[\"'](?:\w+\.)*(\w+)|\b(\w+)\.(?:delay|apply_async)\("),
    ("queue", "defines", ("javascript", "typescript"), r"new\s+Worker\(\s*[\"']([\w-]+)"), ("queue", "uses", ("javascript", "typescript"), r"new\s+Queue\(\s*[\"']([\w-]+)"),
    ("route", "defines", ("python",), r"@\w+\.(?:route|get|post|put|patch|delete)\(\s*[\"']([^\"']+)|\bpath\(\s*r?[\"']([^\"']+)"), ("route", "defines", ("javascript", "typescript"), r"\b(?:app|router|server)\.(?:get|post|put|patch|delete|all)\(\s*[\"'`]([^\"'`]+)"),
    ("route", "defines", ("java", "kotlin"), r"@(?:Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)"), ("route", "defines", ("ruby",), r"(?m)^\s*(?:get|post|put|patch|delete)\s+[\"']([^\"']+)"),
    ("route", "defines", ("go",), r"\.(?:HandleFunc|Handle|GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Delete)\(\s*\"(/[^\"]*)"), ("route", "defines", ("rust",), r"\.route\(\s*\"([^\"]+)|#\[(?:get|post|put|delete)\(\"([^\"]+)"),
    ("route", "uses", ("javascript", "typescript", "vue", "svelte"), r"(?:\bfetch|\baxios(?:\.\w+)?|\bapi\.\w+|\bhttp\.\w+)\(\s*[\"'`](/[^\"'`]*|\$\{\w+\}/[^\"'`]*)"),
    ("script", "uses", ("yaml",), r"(?m)\b(?:npm|pnpm|yarn|bun)\s+run\s+([\w:-]+)"),
]
#: A statement ends at a semicolon or with its string; what it selects from counts wherever it stands.
STATEMENT = re.compile(r"[^;\"']*")
SELECTED = re.compile(rf"\b(?:FROM|from|JOIN|join)\s+{NAME}")
GENERIC_KEYS = frozenset("name type version id url host port path key value title description enabled default config debug env main scripts test build start dev".split())


def flat_keys(value, prefix: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for k, x in value.items():
            dotted = f"{prefix}.{k}" if prefix else str(k)
            yield dotted
            yield from flat_keys(x, dotted)


def config_keys(path: str, text: str, language: str) -> list[str]:
    """Keys that a config file defines and that tell something: all-caps, or compound and not made of common words only."""
    if language == "json":
        try:
            keys = list(flat_keys(json.loads(text)))
        except ValueError:
            return []
    elif language in ("env", "ini", "toml") or path.rpartition("/")[2].startswith(("Dockerfile", ".env")):
        keys = re.findall(r"(?m)^\s*(?:export\s+|ENV\s+|ARG\s+)?([A-Za-z_][\w.-]*)\s*[=\s]", text)
    elif language == "yaml":
        keys = re.findall(r"(?m)^\s*(?:-\s+)?([A-Z][A-Z0-9_]{2,})\s*:", text)
    else:
        return []
    parts = lambda k: [p for p in re.split(r"[._-]|(?<=[a-z])(?=[A-Z])", k) if p]
    telling = [k for k in keys if re.fullmatch(r"[A-Z][A-Z0-9]*(_[A-Z0-9]+)+", k) or (len(parts(k)) > 1 and not all(p.lower() in GENERIC_KEYS for p in parts(k)))]
    return list(dict.fromkeys(telling))


def file_mentions(path: str, text: str, language: str) -> list[tuple[str, str, str, str]]:
    """(path, substrate, role, contract) of one file."""
    out = [(path, "config", "defines", k) for k in config_keys(path, text, language)]
    if language == "json" and path.rpartition("/")[2] == "package.json":
        try:
            out += [(path, "script", "defines", k) for k in json.loads(text).get("scripts", {})]
        except (ValueError, AttributeError):
            pass
    if language == "json":
        try:
            spec = json.loads(text)
        except ValueError:
            spec = None
        if isinstance(spec, dict) and ("openapi" in spec or "swagger" in spec):
            for route, ops in (spec.get("paths") or {}).items():
                out += [(path, "openapi", "defines", op.get("operationId") or f"{m.upper()} {route}") for m, op in (ops or {}).items() if isinstance(op, dict) and m in ("get", "post", "put", "patch", "delete", "head", "options")]
            out += [(path, "openapi", "defines", s) for s in ((spec.get("components") or {}).get("schemas") or {})]
    for substrate, role, languages, pattern in CONTRACTS:
        if languages and language not in languages:
            continue
        for m in re.finditer(pattern, text):
            name = next((g for g in m.groups() if g), None)
            if name:
                name = re.sub(r"\"\s+\"", ".", name)
                out.append((path, substrate, role, name.lower() if substrate == "table" else name))
    if re.search(r"\b(?:SELECT|select)\b", text):
        for m in STATEMENT.finditer(text):
            if at := re.search(r"\b(?:SELECT|select)\b", m[0]):
                out += [(path, "table", "uses", t[1].lower()) for t in SELECTED.finditer(m[0], at.end())]
    return list(dict.fromkeys(out))


# ---- distribution ------------------------------------------------------------------------------------------------


def _decode(raw: bytes) -> str:
    return bytes(raw).decode("utf-8", "replace")


def code_graph(files: DataFrame, keep=lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of guarded files (path, content, language, guard). A file that does not parse is a bare node marked failed.

    keep may write what was found, so that nodes and edges are read off it without parsing twice.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                status, nodes, edges = None, [], []
                if r.guard is not None:
                    status = "incomplete"
                else:
                    try:
                        if r.language == "json":
                            json.loads(_decode(r.content))
                        nodes, edges = python_file(r.path, _decode(r.content)) if r.language == "python" else pattern_file(r.path, _decode(r.content), r.language or "")
                    except (SyntaxError, ValueError, RecursionError):
                        status = "failed"
                out.append((json.dumps({"path": r.path, "kind": "file", "name": r.path}), None, status))
                out += [(json.dumps(n), None, None) for n in nodes]
                out += [(None, json.dumps(dict(zip(("src", "kind", "dst", "probe"), e, strict=True))), None) for e in edges]
            yield pd.DataFrame(out, columns=["node", "edge", "analysis_status"])

    found = keep(files.select("path", "content", "language", "guard").mapInPandas(rows, "node string, edge string, analysis_status string"))
    nodes = found.where("node is not null").select(F.from_json("node", NODE).alias("n"), "analysis_status").select("n.*", "analysis_status")
    edges = found.where("edge is not null").select(F.from_json("edge", EDGE).alias("e")).select("e.*").distinct()
    return nodes, edges


def mentions(files: DataFrame) -> DataFrame:
    """(path, substrate, role, contract) of all readable files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [m for r in pdf.itertuples() for m in file_mentions(r.path, _decode(r.content), r.language or "")]
            yield pd.DataFrame(out, columns=["path", "substrate", "role", "contract"])

    return files.where("guard is null").select("path", "content", "language").mapInPandas(rows, MENTION)


def link_contracts(found: DataFrame, lost: DataFrame) -> DataFrame:
    """(src, kind, dst, reference_status, incomplete): definers alter, users of known contracts query or read.

    lost are (substrate) whose first pass lost a file: their users become incomplete, as the known set may lack something. A contract that
    several files define is ambiguous; of tables and columns only those that create it count, so that many may alter one.
    """
    kind = F.when(F.col("role") != "uses", "alters").when(F.col("substrate") == "config", "reads_config").otherwise("queries")
    counts = (F.col("role") == "creates") | ~F.col("substrate").isin("table", "column")
    definers = found.where("role <> 'uses'").groupBy("substrate", "contract").agg(F.countDistinct(F.when(counts, F.col("path"))).alias("definers"))
    rows = found.join(definers, ["substrate", "contract"]).join(lost.select("substrate").distinct().withColumn("gone", F.lit(True)), "substrate", "left")
    status = F.when(F.col("definers") > 1, "ambiguous")
    return rows.select(F.col("path").alias("src"), kind.alias("kind"), F.concat_ws("::", "substrate", "contract").alias("dst"), status.alias("reference_status"), (F.coalesce("gone", F.lit(False)) & (F.col("role") == "uses")).alias("incomplete")).distinct()


def selector_matches(selectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(selector_id, workload_id) in one directory and namespace whose selector is part of the labels; both are maps."""
    pairs = selectors.join(labels, ["dir", "namespace"])
    fits = F.forall(F.map_entries("selector"), lambda e: F.coalesce(F.try_element_at(F.col("labels"), e["key"]) == e["value"], F.lit(False)))
    return pairs.where((F.size(F.map_keys("selector")) > 0) & fits).select("selector_id", "workload_id")


assert set(v.RESOURCE_KINDS) == {"alters", "queries", "reads_config"}
