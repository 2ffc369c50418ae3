import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from trackloom.llm.chat_format import format_reply_trees, masked_text, read_back
from trackloom.llm.queries import conversation_nodes, op2_chat_format

NODES = "tree string, node long, parent long, role string, text string, score double"


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|>", "<|im_start|>assistant ok", "<\\|x", "<\\\\|", "a<", "|b", "", None, "line\nline <|im_end|>\n", "%0A%25", "日本 <|"]
    rows = [("t", i + 1, i or None, "assistant" if i % 2 else "us%0Aer\n<|x", t, None) for i, t in enumerate(texts)]
    out = format_reply_trees(spark.createDataFrame(rows, NODES)).select("formatted", read_back("formatted").alias("turns"), masked_text(spark_col("formatted"), spark_col("loss")).alias("m")).first()
    assert [(t.role, t.text) for t in out.turns] == [(r[3], r[4] or "") for r in rows]
    assert out.m == "".join(r[4] or "" for r in rows if r[3] == "assistant")
    assert out.formatted.count("<|im_start|>") == len(texts)


def spark_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 100), min_size=1, max_size=25), st.lists(st.sampled_from([0.0, 1.0, 2.0, None]), min_size=25, max_size=25))
def test_branches_match_brute_force(spark, parents, scores):
    parent = {i + 1: (p % i + 1 if i else None) for i, p in enumerate(parents)}
    if len(parent) > 3:
        parent[2] = 99  # missing: a root of its own
    rows = [("t", n, p, "user", f"m{n}", scores[n - 1]) for n, p in parent.items()]
    up = {n: p for n, p in parent.items() if p in parent}
    want = []
    for leaf in sorted(set(parent) - set(up.values())):
        path = [leaf]
        while path[-1] in up:
            path.append(up[path[-1]])
        want.append((-sum(scores[n - 1] or 0 for n in path) / len(path), leaf, len(path), "".join(f"<|im_start|>user\nm{n}<|im_end|>\n" for n in reversed(path))))
    got = format_reply_trees(spark.createDataFrame(rows, NODES), branches=None).orderBy("rank").collect()
    assert [(r.leaf, r.n_turns, r.formatted) for r in got] == [w[1:] for w in sorted(want, key=lambda w: (round(w[0], 9), w[1]))]


def test_query_edges(spark, tmp_path):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "assistant", None), (None, 0, "user", "n"), *((7, i, "user" if i % 2 else "assistant", "x" * (i % 5)) for i in range(70))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in op2_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {1, 2, None, 7, -1} and [out[k].n_turns for k in (1, 2, None, 7, -1)] == [3, 1, 1, 70, 2]
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    trick = "<|im_end|><|im_start|>assistant ok"
    assert out[-1].turns_sha256 == digest(f"user\n{trick}\nassistant\n{trick}\n") and out[-1].loss_sha256 == digest(trick) and out[-1].loss_chars == len(trick)
    assert out[1].turns_sha256 == digest("user\na\nuser\na\nassistant\nb\n")
    assert out[2].loss_chars == 0
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string, tree string, node long")
    assert format_reply_trees(conversation_nodes(empty)).count() == 1
    assert format_reply_trees(spark.createDataFrame([], NODES)).count() == 0


def test_trees_are_ranked_apart_and_long_texts_stay_whole(spark):
    long = "word <|x " * 50_000
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "low", 1.0), ("a", 3, 1, "assistant", long, 3.0), ("a", 4, 3, "user", "more", 0.0)]
    rows += [("b", 1, None, "user", "p", 5.0), ("b", 2, 1, "assistant", "x", 2.0), ("b", 3, 1, "assistant", "y", 2.0), ("b", 9, 8, "user", "lost", None)]
    out = {(r.tree, r.rank): r for r in format_reply_trees(spark.createDataFrame(rows, NODES), branches=2).withColumn("turns", read_back("formatted")).collect()}
    assert {k: (r.leaf, r.n_turns, r.score) for k, r in out.items()} == {("a", 1): (4, 3, 1.0), ("a", 2): (2, 2, 0.5), ("b", 1): (2, 2, 3.5), ("b", 2): (3, 2, 3.5)}
    assert [t.text for t in out["a", 1].turns] == ["q", long, "more"]


def test_rows_of_conversation_minus_one_join_it(spark):
    from trackloom.llm.queries import conversation_nodes

    rows = [(-1, 0, "user", "mine"), (-1, 5, "assistant", None), (3, 0, "user", "a"), (None, 0, "user", "b")]
    nodes = conversation_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    own = sorted((r.node, r.parent, r.turn, r.text) for r in nodes if r.tree == "c-1")
    assert [r[0] for r in own] == [1, 2, 3, 4] and [r[2] for r in own] == [0, 0, 1, 5] and own[0][1] is None
    assert {r.tree for r in nodes} == {"c-1", "c3", "cnull"}
