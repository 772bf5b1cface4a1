"""Toxicity by a weighted finite-state pattern grammar.

A word's machine, of which there are five, gives it a tag and a weight. Four transducers read the tags of a clause one after
the other, each passing them on with its own marks: negation and reported speech mark insults and threats in their reach,
target marks who is aimed at, threat finds its target; a fifth turns marked tags into weighted matches. Their composition is
one machine, compiled to a table once. The weights of insults are learned from the labels as the log odds of their
prefixes, the weights of what the five machines match by a non-negative logistic layer over a document's matches.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweft.llm.shared import WordHash, is_held_out, shingle_sequence, small_batches

# Word lists of the machines. Those of the insult machine are where learning starts.
INSULTS = frozenset(
    "idiot idiots moron morons imbecile stupid dumb fool scum trash garbage filth vermin loser losers clown worthless pathetic disgusting coward liar parasite pig bastard jerk "
    "dumm dummkopf trottel abschaum versager idiota imbécil estúpido basura escoria crétin connard ordure minable".split()
)
THREATS = frozenset("kill hurt destroy beat burn shoot stab punish töten schlagen tuer frapper détruire matar golpear destruir".split())
TARGETS = frozenset("you your yours u he she they them him her those these du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes ellos".split())
NEGATIONS = frozenset("not never nobody isn't aren't wasn't don't nicht kein keine niemals pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says told wrote quoted called claimed alleged sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLAUSE_END = 8
NEGATED, REPORTED, AIMED, AIMS, THREATENS = 1, 2, 4, 8, 16
#: Words that a negation, a target or a threat reaches over.
REACH = 3
FAR = REACH + 1
MARKS = ".,;:!?\"'()[]{}<>*#$%&|-_/\\«»„“”¿¡"
ENDS = (".", "!", "?", ";", ":")
#: Lengths of the prefixes that are tried as insults; beside them every word as a whole, of any length.
PREFIXES = range(3, 25)
#: Behind a pattern that is a whole word. No word's core ends in it.
WHOLE = "$"
FEATURES = ("plain", "negated", "reported", "aimed", "threat")

#: Labelled documents that are learned from, the first by a hash of the id; toxic or not, as they come.
SAMPLE = 8_000
#: Natural logarithm of how much rarer by chance than one in all tried patterns a kept one is.
SURPRISE = 5


class Transducer:
    """A deterministic weighted transducer. step(state, symbol) gives the next state, the symbol passed on and the weights of the arc,
    one for each feature; a path's weights are the sums of its arcs'."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step

    def __rshift__(self, after: Transducer) -> Transducer:
        """The composition: after reads what this one passes on, and weights add up."""

        def step(state, symbol):
            one, passed, w = self.step(state[0], symbol)
            two, out, x = after.step(state[1], passed)
            return (one, two), out, tuple(a + b for a, b in zip(w, x, strict=True))

        return Transducer((self.start, after.start), step)

    def table(self, symbols: list) -> tuple[list[list[int]], list[list[tuple]]]:
        """Next state and weights by state and symbol, of the states that can be reached."""
        place, todo, moves, weights = {self.start: 0}, [self.start], [], []
        for state in todo:  # grows while it is gone through
            row, own = [], []
            for symbol in symbols:
                after, _, w = self.step(state, symbol)
                if after not in place:
                    place[after] = len(todo)
                    todo.append(after)
                row.append(place[after])
                own.append(w if any(w) else ())
            moves.append(row)
            weights.append(own)
        return moves, weights


NONE = (0,) * len(FEATURES)


def _later(n: int) -> int:
    return min(FAR, n + 1)


def negation() -> Transducer:
    """State: words since a negation. Marks insults and threats that it reaches."""

    def step(since, symbol):
        tag, end, marks = symbol
        if tag in (INSULT, THREAT) and since <= REACH:
            marks |= NEGATED
        return FAR if end else 0 if tag == NEGATION else _later(since), (tag, end, marks), NONE

    return Transducer(FAR, step)


def reported_speech() -> Transducer:
    """State: whether the clause reports speech. Marks the insults and threats behind."""

    def step(on, symbol):
        tag, end, marks = symbol
        if tag in (INSULT, THREAT) and on:
            marks |= REPORTED
        return not end and (on or tag == REPORT), (tag, end, marks), NONE

    return Transducer(False, step)


def target() -> Transducer:
    """State: words since a target and since an insult that none was before. Marks insults behind a target, and targets behind an insult."""

    def step(state, symbol):
        tag, end, marks = symbol
        seen, open_ = state
        if tag == INSULT:
            if seen <= REACH:
                marks |= AIMED
            else:
                open_ = 0
        elif tag == TARGET:
            seen = 0
            if open_ <= REACH:
                marks |= AIMS
                open_ = FAR
        return (FAR, FAR) if end else (_later(seen), _later(open_)), (tag, end, marks), NONE

    return Transducer((FAR, FAR), step)


def threat() -> Transducer:
    """State: words since a threat that is neither negated nor reported. Marks the target that it finds."""

    def step(since, symbol):
        tag, end, marks = symbol
        if tag == THREAT and not marks:
            since = 0
        elif tag == TARGET and since <= REACH:
            marks |= THREATENS
            since = FAR
        return FAR if end else _later(since), (tag, end, marks), NONE

    return Transducer(FAR, step)


def matches() -> Transducer:
    """One state. Marked tags become matches: their arcs weigh one, times the weight of the word that is read."""

    def step(state, symbol):
        tag, _, marks = symbol
        insult = tag == INSULT
        kind = 2 if marks & REPORTED else 1 if marks & NEGATED else 0
        return state, symbol, (*(int(insult and kind == k) for k in range(3)), int(bool(marks & (AIMED | AIMS))), int(bool(marks & THREATENS)))

    return Transducer(0, step)


@cache
def grammar_table() -> tuple[list[list[int]], list[list[tuple]]]:
    """The composed machine over the bytes of Tags: a tag, and CLAUSE_END where a clause ends."""
    symbols = [(byte & 7, bool(byte & CLAUSE_END), 0) for byte in range(16)]
    return (negation() >> reported_speech() >> target() >> threat() >> matches()).table(symbols)


def word_core(word: str) -> str:
    return word.strip(MARKS)


def patterns(core: str) -> Iterator[str]:
    """What of a word can be an entry of the insult machine: its prefixes and the word as a whole."""
    yield core + WHOLE
    for n in range(PREFIXES[0], min(len(core), PREFIXES[-1]) + 1):
        yield core[:n]


def tag_word(word: str, lexicon: dict[str, float]) -> tuple[int, float]:
    """The tag that the words' machines give a lower-case word, and its weight: an insult's greatest, one for the others."""
    core = word_core(word)
    end = CLAUSE_END if word.endswith(ENDS) else 0
    weight = max((lexicon[p] for p in patterns(core) if p in lexicon), default=0.0)
    if weight:
        return INSULT | end, weight
    for tag, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
        if core in words:
            return tag | end, 1.0
    return OTHER | end, 1.0


class Tags(dict):
    """Lower-case word to its tag as one byte; the insults met keep their weights. Bounded."""

    def __init__(self, lexicon: dict[str, float], limit: int = 150_000):
        super().__init__()
        self.lexicon, self.limit, self.weights = lexicon, limit, {}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
            self.weights.clear()
        tag, weight = tag_word(word, self.lexicon)
        if tag & 7 == INSULT:
            self.weights[word] = weight
        out = self[word] = bytes([tag])
        return out

    def weight(self, word: str) -> float:
        if word not in self.weights:  # forgotten since
            self.weights[word] = tag_word(word, self.lexicon)[1]
        return self.weights[word]


def clause_matches(tags: bytes, weight_at: Callable[[int], float]) -> list[float]:
    """FEATURES of a whole text: its path's weights through the composed machine."""
    moves, weights = grammar_table()
    out, state = [0.0] * len(FEATURES), 0
    for at, byte in enumerate(tags):
        if w := weights[state][byte]:
            own = weight_at(at) if byte & 7 == INSULT else 1.0
            for k, x in enumerate(w):
                out[k] += own * x
        state = moves[state][byte]
    return out


_INTERESTING = bytes([INSULT, INSULT | CLAUSE_END, THREAT, THREAT | CLAUSE_END])


def text_matches(text: str | None, tags: Tags) -> list[float]:
    words = (text or "").lower().split()
    found = b"".join([tags[w] for w in words])
    if not any(found.count(x) for x in _INTERESTING):
        return [0.0] * len(FEATURES)
    return clause_matches(found, lambda at: tags.weight(words[at]))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's least shingle: copies and most near copies share it."""
    cache = WordHash()
    for batch in batches:
        keys = [int(s.min()) - 2**63 if len(s := shingle_sequence(t.as_py(), cache)) else 0 for t in batch.column(2)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.int64())], names=["doc_id", "label", "text", "sketch"])


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both: tuple[Counter, Counter] = Counter(), Counter()

    def flush():
        keys = sorted(both[0].keys() | both[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([both[1][k] for k in keys], pa.int64()), pa.array([both[0][k] for k in keys], pa.int64())], names=["pattern", "toxic", "clean"])
        both[0].clear()
        both[1].clear()
        return out

    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            both[label].update({p for c in {word_core(w) for w in (text or "").lower().split()} if c for p in patterns(c)})
            if len(both[0]) + len(both[1]) > 500_000:
                yield flush()
    yield flush()


def significant(counts: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """(pattern, toxic, clean) of the patterns that toxic documents have and clean ones lack, far beyond what chance gives among all.

    Of patterns that stand for the same words the longest is kept: one goes where the next letter is nearly always the same.
    """
    often = counts.where("toxic + clean >= 3")
    share = n_toxic / max(1, n_toxic + n_clean)
    longest = often.groupBy(F.expr("substring(pattern, 1, length(pattern) - 1)").alias("pattern")).agg(F.max("toxic").alias("longest"))
    t, c = F.col("toxic"), F.col("clean")
    rows = often.where((t >= 3) & (t * n_clean > 12 * c * n_toxic)).join(longest, "pattern", "left").where(100 * F.coalesce("longest", F.lit(0)) < 60 * t)
    p = t / (t + c)
    surprise = t * F.log(p / share) + F.when(c > 0, c * F.log((1 - p) / max(1e-9, 1 - share))).otherwise(0)
    need = math.log(max(2, often.count())) + SURPRISE
    return rows.where(surprise >= need).select("pattern", "toxic", "clean")


def weigh(found: list[tuple[str, int, int]], first: list[tuple[str, int, int]], n_toxic: int, n_clean: int) -> dict[str, float]:
    """The insult machine's entries: log odds of what was found, and of INSULTS as if one toxic document more had each; only what speaks for toxic."""
    seen = {p: (t, c) for p, t, c in first}
    odds = lambda t, c: math.log(t / (n_toxic + 1)) - math.log(c / (n_clean + 1))
    out = {word + WHOLE: odds(t + 1, c + 0.1) for word in INSULTS for t, c in [seen.get(word + WHOLE, (0, 0))]}
    out |= {p: odds(t + 0.5, c + 0.5) for p, t, c in found}
    return {p: w for p, w in sorted(out.items()) if w > 0.5}


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.01) -> np.ndarray:
    """Newton's method on the weights that are free; the last weight is the bias, the others stay at 0 or more: a match can only add."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    w[-1] = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * np.append(w[:-1], 0)
        free = (w > 0) | (grad < 0)
        free[-1] = True
        hess = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.clip(np.linalg.solve(hess[np.ix_(free, free)], grad[free]), -2, 2)
        before = w.copy()
        w[free] -= step
        w[:-1] = np.maximum(w[:-1], 0)
        if np.abs(w - before).max() < 1e-8:
            break
    return w


def squash(found: np.ndarray) -> np.ndarray:
    return np.log1p(found)


class Grammar:
    """What is learned: the insult machine's entries and the weights of the five machines' matches."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(squash(found) @ self.weights[:-1] + self.weights[-1], -50, 50)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Grammar:
    """Learns from at most sample labelled documents, none held out, one of each group of copies.

    A document with several labels counts as 1 if any is; other values and nulls are no labels. Null and empty texts
    match nothing; labels without a document are left out. Without labels of both classes nothing is learned: only
    INSULTS are insults, and the score is the smoothed share of toxic documents, a half without labels.
    """
    small_batches(docs.sparkSession)
    clean = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    one = clean.where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    few = F.broadcast(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))  # sample ids at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(few, "doc_id").select("doc_id", "label", "text")
    sketched = rows.mapInArrow(_sketch, "doc_id long, label int, text string, sketch long")
    # of each group the smallest id, so that every run learns from the same rows; sample rows at most
    picked = sketched.groupBy("sketch", "label").agg(F.min(F.struct("doc_id", "text")).alias("row")).select("row.doc_id", "label", "row.text").persist()
    try:
        sizes = {r["label"]: r["count"] for r in picked.groupBy("label").count().collect()}
        n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
        entries = weigh([], [], n1, n0)
        if n1 and n0:
            counts = picked.select("doc_id", "label", "text").mapInArrow(_patterns, "pattern string, toxic long, clean long").groupBy("pattern").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).persist()
            seeds = [tuple(r) for r in counts.where(F.col("pattern").isin([w + WHOLE for w in INSULTS])).collect()]
            entries = weigh([tuple(r) for r in significant(counts, n1, n0).collect()], seeds, n1, n0)  # what sample documents teach
            counts.unpersist()
        found = picked.select("doc_id", "label", "text").mapInArrow(_matches(docs.sparkSession.sparkContext.broadcast(entries), True), "doc_id long, label int, found array<double>").collect()  # sample rows of 5 numbers
    finally:
        picked.unpersist()
    found.sort(key=lambda r: (r["doc_id"], r["label"]))
    x, y = np.array([r["found"] for r in found]).reshape(-1, len(FEATURES)), np.array([r["label"] for r in found], float)
    return Grammar(entries, fit_logistic(squash(x), y) if len(y) else np.zeros(len(FEATURES) + 1))


def _matches(lexicon, labelled: bool):
    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags = Tags(lexicon.value)
        for batch in batches:
            found = [text_matches(t.as_py(), tags) for t in batch.column(batch.num_columns - 1)]
            kept = batch.columns[:-1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "label", "found"] if labelled else ["doc_id", "found"])

    return matches


def score_toxicity(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted, and the matches' weights (plain, negated, ...).

    Empty, blank and null texts match nothing and get the bias alone. Rows are scored one by one; null ids are carried
    and not held out; other columns are ignored. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(grammar.lexicon)  # what the sample teaches
    found = rows.mapInArrow(_matches(sent, False), "doc_id long, found array<double>")
    logit = F.lit(float(grammar.weights[-1]))
    for i, w in enumerate(grammar.weights[:-1]):
        logit = logit + F.log1p(F.get("found", F.lit(i))) * float(w)
    held = F.coalesce(is_held_out(F.col("doc_id")), F.lit(False))
    scored = found.withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), logit)))))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *(F.get("found", F.lit(i)).alias(n) for i, n in enumerate(FEATURES)))
