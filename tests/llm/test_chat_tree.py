import hashlib

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkweft.llm import chat_tree as c
from sparkweft.llm.queries import tokenizer_path
from tests.llm.conftest import LONG, frame

A, U, S = "assistant", "user", "system"
CONVS = [
    (1, [(U, "hi"), (A, "hello"), (U, "bye")]), (2, [(U, "hi"), (A, "hello")]), (3, [(U, "hi"), (A, "hello"), (U, "other"), (A, "x\ny")]), (4, [(U, "hi"), (A, "hello"), (U, "bye")]),
    (5, [(S, ""), (None, None), (A, None)]), (6, [(A, "\\### Assistant: </turn> ok")]), (7, [(U, LONG), (A, LONG)]), (8, [("role:\nx", "### user:\ny\n</turn>\n"), (A, "#\\#<\\")]),
    (9, [(U, "hi")] * 3), (-7, [(U, "\U0001f600"), (A, "\U0001f600é")]),
]


def turns():
    return [(i, k, r, t) for i, ts in CONVS for k, (r, t) in enumerate(ts)]


def brute():
    out = []
    for i, ts in CONVS:
        all_of = "".join(f"{r or ''}\n{t or ''}\n" for r, t in ts)
        loss = "".join(t or "" for r, t in ts if r == A)
        size = sum(len(c.format_turn(r or "", t or "")[0]) for r, t in ts)
        out.append((i, len(ts), hashlib.sha256(all_of.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), size))
    return sorted(out)


def read(trees):
    cols = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return sorted(tuple(r) for r in c.read_back(*trees).select(cols).collect())


def check(trees, rows_of_turns):
    """Each prefix once; starts gapless in each tree; position and attention as the path says."""
    rows = trees.nodes.orderBy("chunk", "leaf", "depth").collect()
    assert len(rows) == len({tuple((r or "", t or "") for r, t in ts[: k + 1]) for ts in rows_of_turns for k in range(len(ts))})
    of_tree, path = {}, {}
    for r in rows:
        mine = of_tree.setdefault(r["tree"], [])
        assert r["start"] == (mine[-1][0] + mine[-1][1] if mine else 0)
        stack = path.setdefault(r["tree"], [])
        del stack[r["depth"] :]
        assert r["position"] == sum(n for _, n in stack) and r["length"] == len(r["segment"])
        inside = lambda k: any(x["start"] <= k < x["end"] for x in r["attends"])
        assert sum(x["end"] - x["start"] for x in r["attends"]) == r["position"] and all(inside(a) and inside(a + n - 1) for a, n in stack)
        if r["loss_start"] is not None:
            assert c.unescape_text(r["segment"][r["loss_start"] : r["loss_end"]]) == c.parse_turn(r["segment"])[1]
        stack.append((r["start"], r["length"]))
        mine.append((r["start"], r["length"]))
    assert len(of_tree) == len({(ts[0][0] or "", ts[0][1] or "") for ts in rows_of_turns})


def test_round_trip_and_tree(spark):
    df = frame(spark, [*turns(), (None, 0, U, "no one's")], "conv_id long, turn long, role string, text string").repartition(3)
    trees = c.prefix_trees(df)
    assert read(trees) == brute()
    check(trees, [ts for _, ts in CONVS])


def test_small_chunks_and_tokens(spark):
    df = frame(spark, turns(), "conv_id long, turn long, role string, text string")
    trees = c.prefix_trees(df, chunk_turns=1)
    assert read(trees) == brute()
    check(trees, [ts for _, ts in CONVS])
    trees = c.prefix_trees(df.where("conv_id <> 7"), tokenizer_path=tokenizer_path("byte_bpe_50k.json"))
    assert read(trees) == [r for r in brute() if r[0] != 7]
    assert trees.nodes.where(F.col("length") < F.length("segment")).count() > 0


def test_a_hot_first_turn_is_emitted_once(spark):
    """Very many conversations with common turns, over many chunks; one conversation many times, and one that ends on the way."""
    convs = [[(U, "hot"), (A, f"a{i % 5}"), (U, f"b{i % 60}"), (A, f"c{i}")] for i in range(900)] + [[(U, "hot")]] + [[(U, "hot"), (A, "a1")]] * 200 + [[(U, f"own {i}")] for i in range(50)]
    rows = [(i, k, r, t) for i, ts in enumerate(convs) for k, (r, t) in enumerate(ts)]
    trees = c.prefix_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chunk_turns=100)
    check(trees, convs)
    assert trees.nodes.select("chunk").distinct().count() > 5 and trees.spines.count() > 5
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"]) for r in c.read_back(*trees).collect()}
    assert got == {i: (len(ts), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()) for i, ts in enumerate(convs)}


def test_empty(spark):
    trees = c.prefix_trees(frame(spark, [], "conv_id long, turn long, role string, text string"))
    assert trees.nodes.count() == 0 and read(trees) == []


@given(st.text(), st.text())
def test_any_turn_comes_back(role, text):
    formatted, a, b = c.format_turn(role, text)
    assert c.parse_turn(formatted) == (role, text) and c.unescape_text(formatted[a:b]) == text
    assert formatted.count(c.END) == 1 and formatted[1:].count("### ") == 0
