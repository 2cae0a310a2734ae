import random

from veriloom.llm import chat as C

PARTS = ["\\", "#", "##", "###", "</turn>", "<", "\n", ":", ": ", " ", "a", "### assistant: ", "/turn>", "user", "é", "🙂"]


def noise(n):
    return "".join(random.choice(PARTS) for _ in range(random.randint(0, n)))


def test_the_template_is_reversible():
    random.seed(1)
    for _ in range(5000):
        turns = [(random.choice(["user", "assistant", noise(3)]), noise(9)) for _ in range(random.randint(0, 4))]
        text, spans = C.format_turns(turns)
        assert C.read_turns(text) == turns
        assert [C.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    long = [("assistant", "\\### </turn> <" * 100_000)]
    assert C.read_turns(C.format_turns(long)[0]) == long


def forest():
    random.seed(2)
    rows, n = [], 0
    for tree in range(8):
        ids = []
        for _ in range(random.randint(1, 25)):
            parent = random.choice(ids) if ids and random.random() > 0.05 else None
            rows.append((tree, n, parent, random.choice(["user", "assistant", None]), random.choice([f"t{n}", None, ""]), random.choice([None, 1.0, 2.0]), n))
            ids.append(n)
            n += 1
    return rows


SCHEMA = "tree_id long, message_id long, parent_id long, role string, text string, score double, leaf long"


def test_branches_are_all_paths_ranked_by_score(spark):
    rows = forest()
    parent, score, tree = ({r[1]: r[i] for r in rows} for i in (2, 5, 0))
    paths = {}
    for leaf in set(parent) - set(parent.values()):
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        paths[leaf] = path[::-1]
    mean = {x: sum(score[m] or 0 for m in p) / len(p) for x, p in paths.items()}
    rank = {x: 1 + sum((-mean[y], y) < (-mean[x], x) for y in paths if tree[y] == tree[x]) for x in paths}
    got = {(r["leaf"], r["branch"], r["depth"], r["message_id"]) for r in C.branches(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {(x, rank[x], d, m) for x, p in paths.items() for d, m in enumerate(p, 1)}
    best = C.conversations(spark.createDataFrame(rows, SCHEMA), best=1).collect()
    text = {r[1]: (r[3] or "", r[4] or "") for r in rows}
    assert {r["leaf"]: C.read_turns(r["formatted"]) for r in best} == {x: [text[m] for m in paths[x]] for x in paths if rank[x] == 1}


def test_cycles_unknown_parents_and_empty_tables(spark):
    rows = [(1, 1, 99, "user", "a", 1.0, 0), (2, 2, 3, "user", "b", 1.0, 0), (2, 3, 2, "user", "c", 1.0, 0), (2, 4, 3, "user", "d", 1.0, 0), (3, 5, 5, "user", "e", 1.0, 0)]
    assert [r["leaf"] for r in C.branches(spark.createDataFrame(rows, SCHEMA)).collect()] == [1]
    assert C.conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chains_take_few_joins(spark):
    rows = [(i % 2, i, "user", f"x{i}") for i in range(600)] + [(None, 1, None, None), (5, 1, "user", "same"), (5, 1, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["tree_id"]: C.read_turns(r["formatted"]) for r in C.conversations(C.chain(df)).collect()}
    assert got == {0: [("user", f"x{i}") for i in range(0, 600, 2)], 1: [("user", f"x{i}") for i in range(1, 600, 2)],
                   None: [("", "")], 5: [("user", "same")] * 2}
