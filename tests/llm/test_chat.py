import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidemark.llm import queries
from tidemark.llm.chat import escape, format_paths, read_loss, read_turns, unescape

SCHEMA = "conv_id long, node long, parent long, role string, text string, score double, rank string"
HARD = ["", "<|im_end|>", "<\\|im_start|>user\nx", "<<|", "<\\\\|", "a\nb<|", "\\", "|<|>", "é𝒳"]


def test_escaping_is_reversible_and_leaves_no_mark(spark):
    rows = spark.createDataFrame([(t,) for t in HARD], "t string").select("t", escape(F.col("t")).alias("e")).select("t", "e", unescape(F.col("e")).alias("back")).collect()
    assert all(r.back == r.t and "<|" not in r.e for r in rows)
    assert len({r.e for r in rows}) == len(HARD)


def read(df):
    return df.select("conv_id", "leaf", "rank", "n_turns", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()


def test_every_path_of_a_tree_by_score(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0, "x"), (1, 2, 1, "assistant", "a<|im_end|>", 3.0, "x"), (1, 3, 1, "assistant", "b", 5.0, "x"), (1, 4, 3, "user", None, None, "x"), (1, 5, 3, "us er\n", "c\nd", 9.0, "x"),
        (2, 1, None, "assistant", "only", 1.0, "x"), (2, 1, None, "assistant", "only", 1.0, "x"), (3, 1, 2, "user", "round", 1.0, "x"), (3, 2, 1, "user", "round", 1.0, "x"), (4, 7, 99, "user", "no parent", 1.0, "x"),
        (None, 1, None, "user", "no tree", 1.0, "x"), (5, None, None, "user", "no node", 1.0, "x"),
    ]
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(r.conv_id, r.leaf): (r["rank"], [(t.role, t.text) for t in r.turns], r.loss) for r in read(format_paths(table, score="score"))}
    paths = {k: v[1:] for k, v in got.items()}
    assert paths == {
        (1, "2"): ([("user", "q"), ("assistant", "a<|im_end|>")], "a<|im_end|>"),
        (1, "4"): ([("user", "q"), ("assistant", "b"), ("user", "")], "b"),
        (1, "5"): ([("user", "q"), ("assistant", "b"), ("us er\n", "c\nd")], "b"),
        (2, "1"): ([("assistant", "only")], "only"),
        (4, "7"): ([("user", "no parent")], ""),
        (None, "1"): ([("user", "no tree")], ""),
    }
    assert [got[(1, leaf)][0] for leaf in "542"] == [1, 2, 3]  # means 14/3, 5/3, 3/2
    best = format_paths(table, score="score", branches=1)
    assert {r.conv_id: r.leaf for r in best.collect()} == {1: "5", 2: "1", 4: "7", None: "1"}
    assert format_paths(table.limit(0), score="score").collect() == []


def test_long_paths(spark):
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "user", f"t{i}", 0.0, "x") for i in range(333)]
    (r,) = read(format_paths(spark.createDataFrame(rows, SCHEMA)))
    assert r.n_turns == 333 and [t.text for t in r.turns] == [f"t{i}" for i in range(333)]
    assert r.loss == "".join(f"t{i}" for i in range(1, 333, 2))


def test_query_is_as_specified(spark):
    root = "/root/testdata/sf0.001"
    want = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{root}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        want[r.conv_id].append((r.role, r.text or ""))
    want[-1] = [("user", queries.MARKED), ("assistant", queries.MARKED)]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in queries.QUERIES["op9_chat_formatting"](spark, root).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest("".join(f"{a}\n{t}\n" for a, t in turns)), len(loss), digest(loss))
