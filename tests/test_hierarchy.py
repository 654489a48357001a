import random

import pytest

from normloom.operators import hierarchy as H

SCHEMA = "id string, source string, target string, edge_type string, node string, depth int"


def frame(spark, links):
    return spark.createDataFrame([(str(i), s, t, k, "clash", 99) for i, (s, t, k) in enumerate(links)], SCHEMA)


def brute(links):
    parent = {}
    nodes = set()
    for s, t, k in links:
        if k is None or k.strip().lower() != "derives" or s is None:
            continue
        nodes.add(s)
        if t is not None:
            nodes.add(t)
            parent[s] = min(parent.get(s, t), t)
    out = []
    for n in nodes:
        path = [n]
        while path[-1] in parent and parent[path[-1]] not in path:
            path.append(parent[path[-1]])
        if path[-1] in parent:
            out.append((n, min(path[path.index(parent[path[-1]]) :]), -1))
        else:
            out.append((n, path[-1], len(path) - 1))
    return sorted(out, key=repr)


CASES = {
    "empty": [],
    "chain": [("b", "a", "derives"), ("c", "b", " Derives "), ("d", "c", "DERIVES"), ("d", "c", "derives")],
    "null target is a root": [("a", None, "derives"), ("b", "a", "derives"), (None, "a", "derives"), ("x", "y", None)],
    "null and real target": [("b", None, "derives"), ("b", "a", "derives")],
    "other types": [("b", "a", "covers")],
    "self loop": [("a", "a", "derives"), ("b", "a", "derives")],
    "two cycles with tails": [("a", "b", "derives"), ("b", "c", "derives"), ("c", "a", "derives"), ("t1", "b", "derives"), ("t2", "t1", "derives"), ("y", "x", "derives"), ("x", "y", "derives"), ("r1", "r", "derives")],
    "long cycle": [(f"n{i:03}", f"n{(i + 1) % 37:03}", "derives") for i in range(37)] + [(f"t{i}", f"t{i + 1}" if i < 20 else "n005", "derives") for i in range(21)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_brute_force(spark, rows, name):
    got = H.hierarchy(frame(spark, CASES[name]), with_path=False).select("node", "root", "depth")
    assert rows(got) == brute(CASES[name])


@pytest.mark.parametrize("hot", [200_000, 3])
def test_random_forest_and_hot_parents(spark, rows, hot):
    r = random.Random(5)
    links = [(f"n{i}", f"n{r.randrange(i // 3 + 1)}", "derives") for i in range(1, 120)] + [(f"h{i}", "n0", "derives") for i in range(60)]
    links += [("z1", "z2", "derives"), ("z2", "z1", "derives")]
    got = H.hierarchy(frame(spark, links), with_path=False, hot_children=hot).select("node", "root", "depth")
    assert rows(got) == brute(links)


def test_paths_and_descendants(spark, rows):
    tree = H.hierarchy(frame(spark, CASES["chain"] + [("l", "l", "derives")])).select("node", "root", "depth", "path")
    assert {r["node"]: r["path"] for r in tree.collect()} == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "b", "c", "d"], "l": None}
    assert rows(H.descendant_pairs(tree)) == sorted([("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)], key=repr)
    assert {r["node"]: r["n_descendants"] for r in H.with_descendant_counts(tree).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0, "l": None}
