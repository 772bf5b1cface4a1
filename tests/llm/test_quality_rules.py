import math
import re
from collections import Counter

import numpy as np

from sparkweft.llm import quality_rules as q
from tests.llm.conftest import frame, odd_texts, words


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0d]+", t)
    tri = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c = Counter(tri)
    covered = {k + j for k, x in enumerate(tri) if c[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_features(spark, odd):
    more = [(20, "a b c\na b c\n \n \nx | # < >"), (21, "a a a a"), (22, "a b c a b c a b"), (23, "\x1c x\u0085y \u2028z")]
    df = frame(spark, odd_texts() + more, "doc_id long, text string")
    rows = q.quality_rules(df).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == sorted((str(i), *brute(t)) for i, t in odd_texts() + more)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])


def test_verdicts(spark):
    clean = [(i, words(i, 150)) for i in range(80)]
    shouting = [(100 + i, words(i, 120).upper().replace(" ", "!! ")) for i in range(12)]
    symbols = [(200 + i, words(i, 120).replace(" ", "*** ")) for i in range(12)]
    rows = {r["doc_id"]: r["kept"] for r in q.quality_rules(frame(spark, clean + shouting + symbols, "doc_id long, text string")).collect()}
    assert all(rows[i] for i, _ in clean) and not any(rows[i] for i, _ in shouting + symbols)


def test_empty(spark, none):
    assert q.quality_rules(none).count() == 0


def test_em_finds_planted_accuracies():
    rng = np.random.default_rng(1)
    keep = rng.random(40_000) < 0.8
    votes = np.zeros((len(keep), 3), int)
    for r, (speaks, right) in enumerate([(0.9, 0.95), (0.7, 0.8), (0.8, 0.6)]):
        on = rng.random(len(keep)) < speaks
        good = rng.random(len(keep)) < right
        votes[on, r] = np.where(keep == good, 1, -1)[on]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    table, prior = q.label_model(patterns, counts.astype(float))
    assert abs(prior - 0.8) < 0.06
    right = table[:, 1, 2] / (table[:, 1, 2] + table[:, 1, 0])
    assert right[0] > right[1] > right[2]
    post = q.posterior(patterns, table, prior)
    assert ((post[:, None] >= 0.5)[np.unique(votes, axis=0, return_inverse=True)[1].ravel(), 0] == keep).mean() > 0.9


def plain_votes(text):
    """Each rule's vote, from counts made one character at a time."""
    t = text or ""
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words = brute(text)
    ascii_letters = [c for c in t if c.isascii() and c.isalpha()]
    f = {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words,
        "n_upper": sum(c.isupper() for c in ascii_letters), "n_letters": len(ascii_letters) + sum(not c.isascii() for c in t),
        "n_marks": t.count("!!") + t.count("|") + t.count("??"), "n_lines": sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in t.split("\n")), "false": False,
    }
    return tuple(-1 if eval(no, {}, f) else 1 if eval(yes, {}, f) else 0 for _, no, yes in q.RULES)


def plain_em(votes, rounds=200):
    """The label model document by document: P(vote | class) by rule, and what each document's votes say."""
    prior = 0.8
    table = [[dict(zip((-1, 0, 1), (0.6, 0.25, 0.15), strict=True)), dict(zip((-1, 0, 1), (0.15, 0.25, 0.6), strict=True))] for _ in q.RULES]

    def say():
        out = []
        for v in votes:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[r][1][x] / table[r][0][x]) for r, x in enumerate(v))
            out.append(1 / (1 + math.exp(-odds)))
        return out

    for _ in range(rounds):
        post = say()
        new = []
        for r in range(len(q.RULES)):
            rows = [{x: 1.0 for x in (-1, 0, 1)} for _ in (0, 1)]
            for v, p in zip(votes, post, strict=True):
                rows[0][v[r]] += 1 - p
                rows[1][v[r]] += p
            rows = [{x: n / sum(row.values()) for x, n in row.items()} for row in rows]
            if rows[0][-1] < rows[1][-1]:
                rows[0][-1] = rows[1][-1] = (rows[0][-1] + rows[1][-1]) / 2
            if rows[1][1] < rows[0][1]:
                rows[0][1] = rows[1][1] = (rows[0][1] + rows[1][1]) / 2
            new.append([{x: n / sum(row.values()) for x, n in row.items()} for row in rows])
        prior = min(0.95, max(0.05, (sum(post) + 1) / (len(votes) + 2)))
        table = new
    return say()


def test_verdicts_against_a_plain_version(spark):
    texts = [words(i, 20 + 3 * i) for i in range(40)] + [words(i, 90).upper().replace(" ", "!! ") for i in range(6)] + [words(i, 60).replace(" ", "*** ") for i in range(8)]
    texts += ["same line here again\n" * 30, words(9, 10) + " x y z" * 40, None, "", "a | b"]
    rows = {r["doc_id"]: r for r in q.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = plain_em([plain_votes(t) for t in texts])
    for i, (t, p) in enumerate(zip(texts, want, strict=True)):
        n, _, _, _, repeat = brute(t)
        assert abs(rows[i]["p_keep"] - p) < 1e-4, (i, rows[i]["p_keep"], p)
        assert rows[i]["kept"] == (not (n < 50 or 100 * repeat > 50 * n) and p >= 0.5)
    assert {True, False} == {r["kept"] for r in rows.values()}
