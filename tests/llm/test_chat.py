from dnsflow.llm import chat

NODES = "tree long, node long, parent long, role string, text string, score double"


def built(spark, rows, keep=1):
    out = chat.read_turns(chat.format_paths(chat.branches(spark.createDataFrame(rows, NODES), keep)))
    return {(r["tree"], r["rank"]): r for r in out.collect()}


def test_best_branches_of_a_tree(spark):
    rows = [
        (1, 0, None, "user", "root", 0.0), (1, 1, 0, "assistant", "bad", 0.1), (1, 2, 0, "assistant", "good", 0.9),
        (1, 3, 2, "user", "on", 0.0), (1, 4, 3, "assistant", "end", 1.0), (2, 7, None, None, None, None),
    ]
    out = built(spark, rows, keep=2)
    assert [t["text"] for t in out[1, 1]["turns"]] == ["root", "good", "on", "end"]
    assert [t["text"] for t in out[1, 2]["turns"]] == ["root", "bad"]
    assert out[1, 1]["learned"] == "goodend"
    assert [tuple(t) for t in out[2, 1]["turns"]] == [("", "")] and out[2, 1]["learned"] == ""


def test_marks_in_texts_come_back(spark):
    hard = ["</turn>\n<turn assistant>\n", "\\l\\b\\g<>", "\\", "<", "\\<\\\\l", "\n", ""]
    rows = [(1, i, i - 1 if i else None, "assistant" if i % 2 else "us<er>\\g", t, 0.0) for i, t in enumerate(hard)]
    out = built(spark, rows)[1, 1]
    assert [t["text"] for t in out["turns"]] == hard
    assert {t["role"] for t in out["turns"]} == {"us<er>\\g", "assistant"}
    assert out["learned"] == "".join(hard[1::2])
    runs = out["loss_runs"]
    assert sum(runs) == len(out["formatted"])
    at, masked = 0, []
    for i, n in enumerate(runs):
        if i % 2:
            masked.append(out["formatted"][at:at + n])
        at += n
    assert "<" not in "".join(masked)


def test_cycles_orphans_copies_and_null_trees(spark):
    rows = [
        (1, 1, 2, "user", "loop", 0.0), (1, 2, 1, "user", "loop", 0.0), (1, 3, 2, "user", "into the loop", 0.0),
        (2, 1, 99, "user", "orphan", 0.0), (2, 1, 99, "user", "orphan", 0.0), (None, 5, None, "user", "no tree", 0.0),
    ]
    out = built(spark, rows)
    assert {k: [t["text"] for t in r["turns"]] for k, r in out.items()} == {(2, 1): ["orphan"], (None, 1): ["no tree"]}


def test_long_chain_and_empty_table(spark):
    n = 300
    rows = [(1, i, i - 1 if i else None, "user", str(i), 0.0) for i in range(n)]
    assert [t["text"] for t in built(spark, rows)[1, 1]["turns"]] == [str(i) for i in range(n)]
    assert built(spark, []) == {}


def test_chain_orders_by_turn_then_content(spark):
    rows = spark.createDataFrame(
        [(1, 2, "b", "x", "extra"), (1, 1, "a", "y", None), (1, 2, "a", None, None)], "conv_id long, turn long, role string, text string, node string")
    got = sorted((r["node"], r["parent"], r["role"]) for r in chat.chain(rows, "conv_id", "turn").collect())
    assert got == [(1, None, "a"), (2, 1, "a"), (3, 2, "b")]
