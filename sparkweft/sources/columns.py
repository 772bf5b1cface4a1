"""Columns of SQL: which a file defines and which it uses, found over tokens with the scope of each SELECT.

CREATE TABLE and ALTER TABLE .. ADD define columns, UPDATE .. SET and plain entries of a SELECT list use them. Each pair of brackets is a
scope of its own inside the one around it; a qualified column belongs to the table its qualifier names there, a bare one may belong
to every table of its scope, and linking keeps those that have it. Comments and values count for nothing; SQL in other
languages is read from their string literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"--[^\n]*|/\*.*?(?:\*/|$)|'(?:[^']|'')*'|[\"`\[]?([A-Za-z_]\w*)[\"`\]]?|(\S)", re.S)
LITERAL = re.compile(r"\"\"\"(.*?)\"\"\"|'''(.*?)'''|\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`((?:[^`\\]|\\.)*)`", re.S)
SPEAKS_SQL = re.compile(r"(?i)\b(?:select|update|create|alter)\b")
NUMBER = re.compile("([0-9]+)")
ONLY_DIGITS = bytes(c if chr(c) in "0123456789" else 32 for c in range(256))
TO_ZERO = bytes(48 if chr(c) in "0123456789" else c for c in range(256))
#: Shapes of files that a worker remembers, and the longest text that is tried as one.
SHAPES, LONGEST_SHAPE = 4096, 2000
#: What begins an entry of a table that is no column, and words after a table that are no alias of it.
CONSTRAINTS = frozenset("constraint primary unique foreign check index key like exclude period".split())
CLAUSES = frozenset("where group order having limit offset fetch union intersect except window returning for set values into".split())
JOINS = frozenset("join inner left right full outer cross natural lateral on using as only".split())
NO_COLUMN = frozenset("null true false case distinct all select from current_date current_timestamp".split())


def _tree(sql: str) -> list:
    """Statements as lists of tokens in lower case, what stands in brackets as a list inside."""
    top: list = [[]]
    stack = [top[0]]
    for m in TOKEN.finditer(sql):
        word = m[1] or m[2]
        if word == ";":
            stack = [[]]
            top.append(stack[0])
        elif word == "(":
            inner: list = []
            stack[-1].append(inner)
            stack.append(inner)
        elif word == ")":
            stack = stack[:-1] or stack
        elif word:
            stack[-1].append(word.lower())
        elif m[0].startswith("'"):
            stack[-1].append("''")
    return top


def _is_name(token) -> bool:
    return isinstance(token, str) and (token[0].isalpha() or token[0] == "_")


def _name(tokens: list, at: int) -> tuple[list[str], int]:
    """A dotted name's parts and where it ends."""
    parts = []
    while at < len(tokens) and _is_name(tokens[at]):
        parts.append(tokens[at])
        if at + 1 < len(tokens) and tokens[at + 1] == ".":
            at += 2
        else:
            return parts, at + 1
    return parts, at


def _split(tokens: list) -> Iterator[list]:
    entry: list = []
    for t in tokens:
        if t == ",":
            yield entry
            entry = []
        else:
            entry.append(t)
    yield entry


def _skip(tokens: list, at: int, *words: str) -> int:
    while at < len(tokens) and tokens[at] in words:
        at += 1
    return at


def _sources(tokens: list) -> dict[str, str | None]:
    """Tables of a FROM clause by the names they have there; what a bracket gives has no table."""
    out: dict[str, str | None] = {}
    at, due = 0, True
    while at < len(tokens) and (isinstance(tokens[at], list) or tokens[at] not in CLAUSES):
        if due and (isinstance(tokens[at], list) or (_is_name(tokens[at]) and tokens[at] not in JOINS)):
            table, due = None, False
            if isinstance(tokens[at], list):
                at += 1
            else:
                parts, at = _name(tokens, at)
                table = parts[-1]
            at = _skip(tokens, at, "as")
            alias = at < len(tokens) and _is_name(tokens[at]) and tokens[at] not in CLAUSES | JOINS
            if alias or table:
                out[tokens[at] if alias else table] = table
            at += alias
        else:
            due = due or tokens[at] in (",", "join")
            at += 1
    return out


def _selected(tokens: list, outer: list[dict]) -> tuple[list[tuple[str, str]], list[dict]]:
    """Columns that the SELECTs of one bracket use, and the scopes that brackets inside it see."""
    found, seen = [], {}
    starts = [i for i, t in enumerate(tokens) if t == "select"]
    for begin, end in zip(starts, [*starts[1:], len(tokens)]):  # noqa: B905
        body = tokens[begin + 1 : end]
        if "from" not in body:
            continue
        cut = body.index("from")
        scope = _sources(body[cut + 1 :])
        seen |= scope
        for entry in _split(body[:cut]):
            parts, at = _name(entry, _skip(entry, 0, "distinct", "all"))
            rest = entry[_skip(entry, at, "as") :]
            if not parts or parts[-1] in NO_COLUMN or len(rest) > 1 or not all(_is_name(t) for t in rest):
                continue
            if len(parts) == 1:
                found += [(t, parts[0]) for t in scope.values() if t]
            elif table := next((s[parts[-2]] for s in (scope, *outer) if parts[-2] in s), None):
                found.append((table, parts[-1]))
    return found, [seen, *outer] if seen else outer


def sql_columns(sql: str) -> list[tuple[str, str]]:
    """(role, table.column) of SQL text, each once: creates, defines or uses."""
    out = []
    for statement in _tree(sql):
        head = [t for t in statement if isinstance(t, str)][:8]
        if head[:1] == ["create"] and "table" in head:
            table, at = _name(statement, _skip(statement, statement.index("table") + 1, "if", "not", "exists", "only"))
            if table and at < len(statement) and isinstance(statement[at], list):
                out += [("creates", f"{table[-1]}.{e[0]}") for e in _split(statement[at]) if e and _is_name(e[0]) and e[0] not in CONSTRAINTS]
        elif head[:2] == ["alter", "table"]:
            table, at = _name(statement, _skip(statement, 2, "if", "exists", "only"))
            for change in _split(statement[at:]):
                i = _skip(change, 1, "column", "if", "not", "exists")
                if table and change[:1] == ["add"] and i < len(change) and _is_name(change[i]) and change[i] not in CONSTRAINTS:
                    out.append(("defines", f"{table[-1]}.{change[i]}"))
        elif head[:1] == ["update"] and "set" in statement:
            table, _ = _name(statement, _skip(statement, 1, "only"))
            body = statement[statement.index("set") + 1 :]
            stop = next((i for i, t in enumerate(body) if t in ("where", "from", "returning")), len(body))
            for change in _split(body[:stop]):
                parts, at = _name(change, 0)
                if table and parts and change[at : at + 1] == ["="]:
                    out.append(("uses", f"{table[-1]}.{parts[-1]}"))
        waiting: list[tuple[list, list[dict]]] = [(statement, [])]
        while waiting:
            tokens, outer = waiting.pop()
            found, inner = _selected(tokens, outer)
            out += [("uses", f"{t}.{c}") for t, c in found]
            waiting += [(t, inner) for t in tokens if isinstance(t, list)]
    return list(dict.fromkeys(out))


def file_columns(text: str, language: str) -> list[tuple[str, str]]:
    """(role, table.column) of one file, each once: of SQL itself, else of its string literals."""
    texts = [text] if language == "sql" else [next(filter(None, m.groups()), "") for m in LITERAL.finditer(text)]
    return list(dict.fromkeys(c for t in texts if SPEAKS_SQL.search(t) for c in sql_columns(t)))


@lru_cache(SHAPES)
def _shape(zeros: bytes, pattern: tuple[int, ...], language: str) -> str:
    """file_columns as lines to be formatted with the distinct numbers of a file of this shape, in the order in which they first occur.

    zeros is its text with 0 for each digit, pattern tells which numbers are equal. Others of the same lengths stand in for them: there are
    at most as many of a length as it has numbers.
    """
    parts = NUMBER.split(zeros.decode())
    used: dict[int, int] = {}
    names: list[str] = []
    for i, which in zip(range(1, len(parts), 2), pattern, strict=True):
        if which == len(names):
            n = len(parts[i])
            names.append(f"{used.get(n, 0):0{n}}")
            used[n] = used.get(n, 0) + 1
        parts[i] = names[which]
    place = {n: f"{{{i}}}" for i, n in enumerate(names)}
    return "\n".join(f"{role} {NUMBER.sub(lambda m: place[m[0]], contract)}" for role, contract in file_columns("".join(parts), language))


def column_lines(text: str, language: str) -> str:
    """file_columns as lines of role and column.

    Generated and repeated code differs in numbers only, as names end in them. Other numbers of the same length, equal where they were
    equal, change no token but by that, so such files are parsed once for all.
    """
    if len(text) > LONGEST_SHAPE:
        return "\n".join(map(" ".join, file_columns(text, language)))
    raw = text.encode()
    first: dict[str, int] = {}
    pattern = tuple([first.setdefault(n, len(first)) for n in raw.translate(ONLY_DIGITS).decode().split()])
    return _shape(raw.translate(TO_ZERO), pattern, language).format(*first)


def column_mentions(files: DataFrame) -> DataFrame:
    """(path, substrate column, role, contract table.column) of files (path, text, language), to be linked as other contracts are.

    Null and empty texts mention nothing, repeated rows repeat theirs, an empty table gives an empty one.
    """
    return mentions_of(column_rows(files))


def column_rows(files: DataFrame) -> DataFrame:
    """(path, found) of the files that mention columns: found are their column_lines."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path, text, language = (batch.column(i) for i in range(3))
            found = [column_lines(t, x) for t, x in zip(text.to_pylist(), language.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([path, pa.array(found, pa.string())], names=["path", "found"])

    return files.where("text is not null").select("path", "text", "language").mapInArrow(rows, "path string, found string").where("found <> ''")


def mentions_of(found: DataFrame) -> DataFrame:
    """column_mentions of what column_rows found."""
    line = found.select("path", F.explode(F.split("found", "\n")).alias("line"))
    return line.select("path", F.lit("column").alias("substrate"), F.substring_index("line", " ", 1).alias("role"), F.substring_index("line", " ", -1).alias("contract"))
