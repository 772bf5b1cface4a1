"""Secret scans in DataFrame functions only: three fixed pattern kinds and sliding-window entropy over candidate strings.

Spans come from two regular-expression calls on the whole text: the matches and what lies between them; running sums of
their lengths are the offsets, in code points. Everything stays in the scan's own stage: no shuffle, no Python.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import free_names

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}+"
ASSIGN_LEAST = 6

#: What entropy is measured on: a whole run of these characters that has a letter and a digit.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]"
CANDIDATE = rf"(?<!{RUN})(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z]){RUN}{{20,}}+"
WINDOW = 20
#: Bits per character from which a window of a class counts as a secret; a class holds strings of its characters only.
CLASSES = [("hex", "^[0-9A-Fa-f-]+$", 3.3), ("token", "", 3.9)]
#: Tried before CLASSES: strings of smaller alphabets, whose windows hold fewer bits, and short ones of two cases. Each value is
#: about what 99 % of random strings of 20 characters of that alphabet reach.
NARROW = [("one-case hex", "^([0-9A-F]+|[0-9a-f]+)$", 2.9), ("one-case", "^([A-Z0-9]+|[a-z0-9]+)=*$", 3.35), ("short two-case", "^[A-Za-z0-9]{20,31}$", 3.62)]
#: Strings that are never secrets however they look.
ALLOWED = [r"(?i)example", r"(?i)placeholder", r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(?i)^sha(256|384|512)-", r"(?i)^(https?|www|utm)", r"^[0-9/_=+-]+[A-Z]?$"]
KINDS = ("assign", "access", "hex", "entropy")
#: c log2 c for a character seen c times in a window, in millionths of a bit: sums of whole numbers don't drift.
WEIGHT = [round(c * math.log2(c) * 1_000_000) if c else 0 for c in range(WINDOW + 1)]


#: Steps of a prefix computation by doubling: enough for a billion elements.
_DOUBLING = f"array({', '.join(str(1 << k) for k in range(30))})"
#: Code points of the blocks that texts are cut into before pieces are taken out of them.
BLOCK = 1000
_NO_SPANS = "cast(array() as array<struct<start:int,kind:int,end:int>>)"


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, join) -> Column:
    """The running join (a sum, a maximum) of an array: log2(n) rounds, each joining an element with the one 2^k before it."""
    steps = F.filter(F.expr(_DOUBLING), lambda d: d < F.size(values))
    return F.aggregate(steps, values, lambda acc, d: F.transform(acc, lambda x, i: F.when(i >= d, join(x, F.get(acc, i - d))).otherwise(x)))


def _spans(text: Column, found: Column, pattern: str, kind: int) -> Column:
    """Array of (start, kind, end) of found, the matches of pattern in text, from the lengths of the matches and the gaps between."""
    gaps = F.split(text, pattern, -1)
    steps = _bound(gaps, lambda g: F.transform(found, lambda m, i: F.length(m) + F.length(F.get(g, i))))
    ends = _bound(steps, lambda s: running(s, lambda x, y: x + y))
    spans = _bound(ends, lambda e: F.transform(found, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(e, i).alias("end"))))
    return F.when(F.size(found) > 0, spans).otherwise(F.expr(_NO_SPANS))


def _touches(c: Column, spans: Column) -> Column:
    """Whether span c overlaps one of spans, which are in order and don't overlap each other: the last that starts before c ends
    decides, and is found by bisection."""
    steps = F.reverse(F.filter(F.expr(_DOUBLING), lambda d: d <= F.size(spans)))
    before = F.aggregate(steps, F.lit(0), lambda n, d: F.when((n + d <= F.size(spans)) & (F.get(spans, n + d - 1)["start"] < c["end"]), n + d).otherwise(n))
    return F.coalesce(F.get(spans, before - 1)["end"] > c["start"], F.lit(False))


def least_spread(candidate: Column) -> Column:
    """The least sum of c log2 c (millionths) over all windows of a string, from counts that each step changes by two."""
    weight = F.expr(f"array({', '.join(map(str, WEIGHT))})")
    codes = F.transform(F.regexp_extract_all(candidate, F.lit("(?s)."), F.lit(0)), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    # bound to a variable, so that it is worked out once and not for each step
    paired = lambda all_of: F.transform(all_of, lambda c, i: F.struct(c.alias("put"), F.when(i >= WINDOW, F.get(all_of, i - WINDOW)).otherwise(-1).alias("gone"), i.alias("i")))
    steps = F.get(F.transform(F.array(codes), paired), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        put, gone = F.get(acc["counts"], x["put"]), F.when(x["gone"] >= 0, F.get(acc["counts"], x["gone"])).otherwise(0)
        less = F.when(x["gone"] >= 0, F.get(weight, gone - 1) - F.get(weight, gone)).otherwise(0)
        held = put - F.when(x["gone"] == x["put"], 1).otherwise(0)
        total = acc["sum"] + less + F.get(weight, held + 1) - F.get(weight, held)
        counts = F.transform(acc["counts"], lambda c, k: c + F.when(k == x["put"], 1).otherwise(0) - F.when(k == x["gone"], 1).otherwise(0))
        return F.struct(counts.alias("counts"), total.alias("sum"), F.when(x["i"] >= WINDOW - 1, F.least(acc["least"], total)).otherwise(acc["least"]).alias("least"))

    zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0).alias("sum"), F.lit(2**31 - 1).alias("least"))
    return F.aggregate(steps, zero, step)["least"]


def most_allowed(bits: float) -> int:
    """The entropy of a window is log2(w) - sum / w: the greatest sum at which it has at least so many bits."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * 1_000_000)


def _is_random(candidate: Column) -> Column:
    bound = None
    for _, chars, bits in reversed(NARROW + CLASSES):
        bound = F.lit(most_allowed(bits)) if bound is None else F.when(candidate.rlike(chars), most_allowed(bits)).otherwise(bound)
    return least_spread(candidate) <= bound


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    """docs with out_col: an array of (start, kind, end) by start and kind; kind is an index of KINDS, offsets are code points.

    A null text is empty and has none. Base kinds are leftmost matches that don't overlap within a kind; an assignment
    whose value has under six characters is consumed and dropped. Entropy spans are whole candidate strings that touch
    no base span and match nothing of ALLOWED. Rows are independent: repeated rows, null ids and other columns pass through,
    whatever their names; a column named out_col is replaced. An empty table gives an empty one. The work is n log n in the
    matches of a text.
    """
    text, assign, access, hexes, candidate, values, entropy, base = free_names(docs, "text_", "assign_", "access_", "hex_", "candidate_", "values_", "entropy_", "base_")
    col = F.col
    all_of = lambda pattern, group: F.regexp_extract_all(col(text), F.lit(pattern), F.lit(group))
    whole = docs.withColumn(text, F.coalesce(col(text_col).cast("string"), F.lit("")))
    found = whole.withColumns({assign: all_of(ASSIGN, 0), access: all_of(ACCESS, 0), hexes: all_of(HEX, 0), candidate: all_of(CANDIDATE, 0)})
    lengths = F.when(F.size(assign) > 0, F.transform(all_of(ASSIGN, 2), F.length)).otherwise(F.expr("cast(array() as array<int>)"))
    spans = found.withColumns(
        {
            values: lengths,
            assign: _spans(col(text), col(assign), ASSIGN, 0),
            access: _spans(col(text), col(access), ACCESS, 1),
            hexes: _spans(col(text), col(hexes), HEX, 2),
            entropy: _spans(col(text), col(candidate), CANDIDATE, 3),
        }
    )
    spans = spans.withColumn(assign, F.filter(assign, lambda s, i: F.get(col(values), i) >= ASSIGN_LEAST))
    spans = spans.withColumn(base, F.array_sort(F.concat(assign, access, hexes)))
    allowed = lambda c: F.array_contains(F.array(*[c.rlike(p) for p in ALLOWED]), True)
    clash = lambda c: _touches(c, col(assign)) | _touches(c, col(access)) | _touches(c, col(hexes))
    candidates = F.arrays_zip(col(entropy).alias("span"), col(candidate).alias("string"))
    extra = F.filter(candidates, lambda c: ~clash(c["span"]) & ~allowed(c["string"]) & _is_random(c["string"]))
    extra = F.transform(extra, lambda c: c["span"])
    out = spans.withColumn(out_col, F.when(F.size(candidate) > 0, F.array_sort(F.concat(col(base), extra))).otherwise(col(base)))
    return out.drop(text, assign, access, hexes, candidate, values, entropy, base)


def span_string(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def redact(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """text with each span, or run of overlapping spans, replaced by mask; spans are as find_secrets gives them, in order.

    A null text stays null, one without spans as it is. The text is cut into blocks first, so that a piece costs its own
    length and a block's, not the length of all text before it.
    """
    def piece(blocks: Column, a: Column, b: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        some = lambda k, start, n: F.coalesce(F.substring(F.get(blocks, k), start + 1, n), F.lit(""))
        middle = F.when(j > i + 1, F.array_join(F.slice(blocks, i + 2, j - i - 1), "")).otherwise("")
        return F.when(i == j, some(i, a % BLOCK, b - a)).otherwise(F.concat(some(i, a % BLOCK, F.lit(BLOCK)), middle, some(j, F.lit(0), b % BLOCK)))

    def cut(blocks: Column, reach: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
        parts = F.transform(spans, lambda s, i: F.when(s["start"] >= before(i), F.concat(piece(blocks, before(i), s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(parts, ""), piece(blocks, F.element_at(reach, -1), F.length(text)))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    done = _bound(F.transform(spans, lambda s: s["end"]), lambda ends: _bound(running(ends, F.greatest), lambda reach: _bound(blocks, lambda b: cut(b, reach))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
