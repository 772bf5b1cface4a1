"""Quality rules as weak supervision: rules vote or abstain, EM learns how far each can be trusted, posteriors decide.

The label model sees only how often each pattern of votes occurs. With k rules there are at most 3^k patterns, so what
reaches the driver has a fixed bound however many documents there are, and every document counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import WordHash, per_worker, shared_table, small_batches, window_hashes, word_hashes

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_letters", "n_marks", "n_lines")

#: Rule: (name, votes to reject when true, votes to keep when true); neither: it abstains. A text fails in one way or
#: another, so a rule that finds nothing wrong abstains; only length and fluency speak for a text.
RULES = [
    ("length", "n_words < 30", "n_words >= 80"),
    ("symbols", "10 * n_symbols > n_words", "false"),
    ("symbol_share", "20 * n_symbols > word_chars", "false"),
    ("letters", "10 * n_letters < 7 * word_chars", "false"),
    ("marks", "4 * n_marks > n_words", "false"),
    ("shouting", "3 * n_upper > n_letters", "false"),
    ("repeated_words", "5 * n_repeat_words > 2 * n_words", "false"),
    ("repeated_lines", "2 * n_dup_lines > n_lines", "false"),
    ("fluency", "false", "12 * n_symbols < n_words and 3 * n_upper < n_letters and 5 * n_repeat_words < 2 * n_words and 5 * n_marks < n_words"),
]


def text_features(text: str | None, cache: WordHash) -> tuple[int, ...]:
    """FEATURES of one whole text; null and blank texts have none of anything."""
    if not text:
        return (0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    repeat = 0
    if n >= 3:
        win = window_hashes(word_hashes(words, cache), 3)
        order = np.argsort(win, kind="stable")
        same = np.zeros(len(win), bool)
        eq = win[order][1:] == win[order][:-1]
        same[order[1:][eq]] = True
        same[order[:-1][eq]] = True
        covered = np.zeros(n, bool)
        for i in range(3):
            covered[i : n - 2 + i] |= same
        repeat = int(covered.sum())
    codes = np.frombuffer(raw, np.uint8)
    letters = (codes | 32) - np.uint8(97) < 26
    upper = letters & (codes < 97)
    chars = len(text) - sum(text.count(x) for x in BLANK)
    marks = text.count("!!") + text.count("|") + text.count("??")
    return n, chars, sum(text.count(x) for x in SYMBOLS), len(lines) - len(set(lines)), repeat, int(upper.sum()), int(letters.sum()) + int((codes >= 192).sum()), marks, len(lines)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = per_worker("words", WordHash)
    for batch in batches:
        rows = [text_features(t.as_py(), cache) for t in batch.column(1)]
        cols = np.array(rows, np.int64).reshape(-1, len(FEATURES)).T
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in cols)], names=["doc_id", *FEATURES])


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float]:
    """EM over vote patterns (rows of -1, 0, 1): P(vote | class) for each rule as an array [rule, class, vote], and P(keep).

    Class 1 is "keep". It starts from rules that are right four times in five. A rule can come to say nothing but not
    to vote against its own meaning: where EM would turn it round, it is held at even odds.
    """
    k = patterns.shape[1]
    votes = np.stack([patterns == v for v in (-1, 0, 1)], axis=2).astype(float)  # [pattern, rule, vote]
    table = np.empty((k, 2, 3))
    table[:, 0], table[:, 1] = (0.6, 0.25, 0.15), (0.15, 0.25, 0.6)
    prior = 0.8
    for _ in range(rounds):
        post = posterior(patterns, table, prior)
        weight = np.stack([counts * (1 - post), counts * post])  # [class, pattern]
        new = np.einsum("cp,prv->rcv", weight, votes) + 1.0
        new /= new.sum(2, keepdims=True)
        turned = new[:, 0, 0] < new[:, 1, 0]
        new[turned, :, 0] = new[turned, :, 0].mean(1, keepdims=True)
        turned = new[:, 1, 2] < new[:, 0, 2]
        new[turned, :, 2] = new[turned, :, 2].mean(1, keepdims=True)
        new /= new.sum(2, keepdims=True)
        moved, table = np.abs(new - table).max(), new
        prior = float(np.clip((weight[1].sum() + 1) / (counts.sum() + 2), 0.05, 0.95))
        if moved < 1e-9:
            break
    return table, prior


def posterior(patterns: np.ndarray, table: np.ndarray, prior: float) -> np.ndarray:
    """P(keep | votes) for each pattern."""
    k = np.arange(patterns.shape[1])
    odds = np.log(prior / (1 - prior)) + (np.log(table[k, 1, patterns + 1]) - np.log(table[k, 0, patterns + 1])).sum(1)
    return 1 / (1 + np.exp(-odds))


def quality_votes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the features and each rule's vote (-1 reject, 0 abstain, 1 keep) as votes array."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, " + ", ".join(f"{x} long" for x in FEATURES)
    vote = [F.when(F.expr(no), -1).when(F.expr(yes), 1).otherwise(0).cast("int") for _, no, yes in RULES]
    return rows.mapInArrow(_features, schema).withColumn("votes", F.array(*vote))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, the base features, base_failed, p_keep and kept.

    Null, empty and blank texts have no words, fail the base rule and are not kept. Rows that repeat an id are judged
    each by itself; a null id is carried. Other columns are ignored. An empty table gives an empty one.
    """
    voted = shared_table(quality_votes(docs, id_col, text_col), "votes")
    seen = sorted((tuple(r["votes"]), r["n"]) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())  # at most 3^9 rows
    spark = docs.sparkSession
    if seen:
        patterns, counts = np.array([p for p, _ in seen]), np.array([n for _, n in seen], float)
        table, prior = label_model(patterns, counts)
        known = list(zip([list(p) for p, _ in seen], posterior(patterns, table, prior).tolist(), strict=True))
    else:
        known = []
    posteriors = spark.createDataFrame(known, "votes array<int>, p_keep double")
    out = voted.join(F.broadcast(posteriors), "votes", "left")  # as many rows as there are patterns, 3^9 at most
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "p_keep",
        (~failed & (F.col("p_keep") >= keep_at)).alias("kept"),
    )
