import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sparkweft.llm import toxicity as t
from tests.llm.conftest import frame, odd_texts, words

BAD = ["grobnik", "grobnal", "vilefoo", "vilefee", "scumlet"]


def corpus(n=400):
    docs, labels = [], []
    for i in range(n):
        w, toxic = words(i, 80).split(), i % 5 == 0
        if toxic:
            for k in range(3):
                w.insert(7 + 20 * k, BAD[(i // 5 + k) % 5] + ("," if k else ""))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_learned_grammar(spark):
    docs, labels = corpus()
    d = frame(spark, docs, "doc_id long, text string")
    grammar = t.fit_toxicity(d, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    assert any(p.startswith("grob") for p in grammar.lexicon)
    truth = dict(labels)
    rows = t.score_toxicity(d, grammar).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)


def test_odd_texts_and_missing_labels(spark, odd, none):
    grammar = t.fit_toxicity(odd, spark.createDataFrame([], "doc_id long, toxic int"))
    rows = t.score_toxicity(odd, grammar).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r["score"] <= 1 for r in rows)
    assert t.score_toxicity(none, grammar).count() == 0


def found(text, lexicon=None):
    return dict(zip(t.FEATURES, t.text_matches(text, t.Tags(lexicon or {"idiot": 2.0})), strict=True))


def test_clauses():
    assert found("what an idiot")["plain"] == 2
    assert found("he is not an idiot") | {"aimed": 0} == {"plain": 0, "negated": 2, "reported": 0, "aimed": 0, "threat": 0}
    assert found("not that. idiot")["plain"] == 2
    assert found("she said he was some idiot")["reported"] == 2
    assert found("she said so. idiots here")["plain"] == 2
    assert found("you idiot")["aimed"] == 2 and found("idiot, you")["aimed"] == 1 and found("a b c d idiot")["aimed"] == 0
    assert found("I will kill you")["threat"] == 1 and found("never kill you")["threat"] == 0 and found("kill time. you")["threat"] == 0
    assert found("xy", {"xy$": 1.5})["plain"] == 1.5 and found("xyz", {"xy$": 1.5})["plain"] == 0
    long = "q" * 40
    assert found(long + "a", {long + "a$": 1.0})["plain"] == 1 and found(long + "b", {long + "a$": 1.0})["plain"] == 0
    assert found(None) == found("") == found("nothing here") == dict.fromkeys(t.FEATURES, 0.0)


def plainly(tags, weights):
    """The grammar's matches by looking at the words around each word of a clause."""
    out = [0.0] * 5
    clause = []
    for at, byte in enumerate(tags):
        clause.append((byte & 7, weights[at]))
        if byte & t.CLAUSE_END or at == len(tags) - 1:
            kinds = [k for k, _ in clause]
            held = lambda i: any(kinds[j] == t.NEGATION for j in range(max(0, i - t.REACH - 1), i))
            told = lambda i: t.REPORT in kinds[:i]
            aimed = lambda i: t.TARGET in kinds[max(0, i - t.REACH) : i]
            for i, (kind, w) in enumerate(clause):
                if kind == t.INSULT:
                    out[2 if told(i) else 1 if held(i) else 0] += w
                    out[3] += w if aimed(i) else 0
                if kind == t.TARGET:
                    near = [j for j in range(max(0, i - t.REACH), i)]
                    since = max([j + 1 for j in near if kinds[j] == t.TARGET], default=0)
                    out[3] += any(kinds[j] == t.INSULT and not aimed(j) for j in near if j >= since)
                    out[4] += any(kinds[j] == t.THREAT and not held(j) and not told(j) for j in near if j >= since)
            clause = []
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([0, 1, 1, 2, 2, 3, 3, 4, 5]), st.sampled_from([0, 0, 0, 0, 0, 0, 0, t.CLAUSE_END]), st.integers(1, 4)), max_size=30))
def test_composed_machine_against_plain_rules(rows):
    tags, weights = bytes(k | e for k, e, _ in rows), [float(w) for *_, w in rows]
    assert t.clause_matches(tags, weights.__getitem__) == plainly(tags, weights)


def test_composition_adds_weights_and_passes_symbols():
    up = t.Transducer(0, lambda s, x: (s + x, x + 1, (x, 0)))
    down = t.Transducer(0, lambda s, x: (s, x * 2, (0, x)))
    both = up >> down
    state, out, w = both.step(both.start, 3)
    assert (state, out, w) == ((3, 0), 8, (3, 4))
    moves, weights = t.grammar_table()
    assert len(moves) == len(weights) > 50 and all(len(r) == 16 for r in moves)


def test_scores_against_a_plain_version(spark):
    docs, labels = corpus(200)
    d = frame(spark, [*docs, *[(1000 + i, x) for i, x in odd_texts() if i is not None]], "doc_id long, text string")
    grammar = t.fit_toxicity(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert (grammar.weights[:-1] >= 0).all()
    for r in t.score_toxicity(d, grammar).join(d.select("doc_id", "text").distinct(), "doc_id").collect():
        words_ = (r["text"] or "").lower().split()
        tagged = [t.tag_word(w, grammar.lexicon) for w in words_]
        x = plainly(bytes(k for k, _ in tagged), [w for _, w in tagged])
        logit = grammar.weights[-1] + sum(w * np.log1p(v) for w, v in zip(grammar.weights, x, strict=False))
        assert abs(r["score"] - 1 / (1 + np.exp(-np.clip(logit, -50, 50)))) < 1e-9


def test_forgotten_words_keep_their_weight():
    tags = t.Tags({"idiot": 2.0}, limit=3)
    assert t.text_matches("idiot a b c d e f idiotic", tags)[0] == 4


def test_significance(spark):
    counts = [("gro", 40, 0), ("grob", 40, 0), ("grobn", 12, 0), ("the", 40, 400), ("rare", 3, 0), ("xy$", 30, 0), *((f"w{i}", 1, 3) for i in range(5000))]
    rows = spark.createDataFrame(counts, "pattern string, toxic long, clean long")
    assert sorted(r["pattern"] for r in t.significant(rows, 40, 400).collect()) == ["grob", "grobn", "xy$"]


def test_logistic():
    x = np.array([[0.0], [0], [0], [1], [1], [2]])
    y = np.array([0, 0, 0, 1, 1, 1.0])
    w = t.fit_logistic(x, y)
    p = 1 / (1 + np.exp(-(x[:, 0] * w[0] + w[1])))
    assert (p[:3] < 0.2).all() and (p[3:] > 0.8).all()
    assert t.fit_logistic(np.hstack([x, -x]), y)[1] == 0


def test_labels_mostly_toxic(spark):
    """Insults are learned at any share of toxic documents."""
    docs = [(i, " ".join([*words(i, 40).split(), *([f"{BAD[i % 5]}, {BAD[(i + 1) % 5]}"] if i % 5 < 3 else [])])) for i in range(400)]
    grammar = t.fit_toxicity(frame(spark, docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 < 3)) for i, _ in docs], "doc_id long, toxic int"))
    assert any(p.startswith("grob") for p in grammar.lexicon) and any(p.startswith("vile") for p in grammar.lexicon)
