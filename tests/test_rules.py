"""Rules that are applied one by one in a plain loop: change logs, breadth-first search, chains with their call sites."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import assets, callgraph
from factloom.sources import work

ASSETS = "id string, status string, reviewer string, confirmed_at string, owner string"
CHANGES = "id string, action string, by string, at string, seq int, status string, reviewer string, confirmed_at string"


def replay(rows, log):
    """The log in its order, a change at a time."""
    state = {r[0]: list(r) for r in rows}
    for key, action, by, at, _, status, reviewer, confirmed in sorted(log, key=lambda c: (c[3], c[4])):
        if key not in state or (action == "update" and status and status not in assets.STATUSES):
            continue
        own = state[key]
        if action == "confirm":
            own[1:4] = "confirmed", by, at
        elif action == "stale":
            own[1] = "stale"
        elif action == "update":
            own[1], own[2], own[3] = status or own[1], reviewer or own[2], confirmed or own[3]
            if own[1] == "confirmed" and not own[3]:
                own[2], own[3] = own[2] or by, at
    return {k: tuple(x or None for x in v) for k, v in state.items()}


def test_stamps_stay(spark):
    log = [("a", "confirm", "bob", "5", 1, None, None, None), ("a", "stale", "eve", "9", 2, None, None, None), ("b", "confirm", "bob", "5", 1, None, None, None), ("b", "stale", "x", "6", 2, None, None, None), ("b", "confirm", "eve", "9", 3, None, None, None)]
    df = spark.createDataFrame([("a", "draft", None, None, "o"), ("b", "draft", "", "", "o"), ("c", "draft", "", None, "o")], ASSETS)
    got = {r["id"]: tuple(r) for r in assets.transition(df, spark.createDataFrame(log, CHANGES)).collect()}
    assert got == {"a": ("a", "stale", "bob", "5", "o"), "b": ("b", "confirmed", "eve", "9", "o"), "c": ("c", "draft", None, None, "o")}


@pytest.mark.parametrize("seed", range(3))
def test_change_logs(spark, seed):
    rng = random.Random(seed)
    rows = [(f"a{i}", rng.choice(assets.STATUSES), rng.choice([None, "", "first"]), rng.choice([None, "", "t0"]), "o") for i in range(200)]
    log = [
        (f"a{rng.randrange(220)}", rng.choice(["confirm", "stale", "update", "update", "update", "rename"]), rng.choice("xyz"), f"t{rng.randint(1, 9)}", i, rng.choice([None, "", "confirmed", "draft", "odd"]), rng.choice([None, "", "r"]), rng.choice([None, "", "", "t9"]))
        for i in range(700)
    ]
    got = {r["id"]: tuple(r) for r in assets.transition(spark.createDataFrame(rows, ASSETS), spark.createDataFrame(log, CHANGES)).collect()}
    assert got == replay(rows, log)


def search(edges, entries, depth):
    """Breadth-first search: edges in their order, the first discovery counts."""
    out = collections.defaultdict(list)
    for src, dst, _ in sorted(edges, key=lambda e: e[2]):
        out[src].append(dst)
    found = {}
    for entry in entries:
        paths, front = {entry: [entry]}, [entry]
        for _ in range(depth):
            following = []
            for node in front:
                for dst in out[node]:
                    if dst not in paths:
                        paths[dst] = [*paths[node], dst]
                        following.append(dst)
            front = following
        found |= {(entry, node): path for node, path in paths.items()}
    return found


@pytest.mark.parametrize("n, m, depth, block", [(60, 70, 6, 4096), (60, 70, 2, 16), (40, 300, 6, 8), (30, 25, 6, 4096), (12, 0, 3, 8)])
def test_reachability(spark, monkeypatch, n, m, depth, block):
    """Sparse graphs, in which most pairs are out of reach, and dense ones; loops, parallel edges, entries without edges, several bitmaps."""
    monkeypatch.setattr(callgraph, "BLOCK", block)
    rng = random.Random(n + m)
    edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}", i) for i in range(m)]
    entries = [f"n{i}" for i in range(0, n, 3)] + ["alone", "n0"]
    e, starts = spark.createDataFrame(edges, "src string, dst string, ord long"), spark.createDataFrame([(x,) for x in entries], "entry string")
    want = search(edges, entries, depth)
    rows = lambda df: {(r["entry"], r["node"]): r["path"] for r in df.collect()}
    got = callgraph.reachable_paths(e, starts, depth)
    assert got.count() == len(want) and rows(got) == want
    if m < 100:
        assert len(want) < len(set(entries)) * n / 2
    some = {f"n{i}" for i in range(0, n, 4)}
    targets = spark.createDataFrame([(x,) for x in some], "node string")
    assert rows(callgraph.reachable_paths(e, starts, depth, targets)) == {k: p for k, p in want.items() if k[1] in some}


def test_tables_go_with_their_scope(spark):
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work.work_dir(spark)}/factloom")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {str(f.getPath().getName()) for f in files.listStatus(path)} if files.exists(path) else set()
    before = names()
    with work.scope():
        e, starts = spark.createDataFrame([("a", "b", 1)], "src string, dst string, ord long"), spark.createDataFrame([("a",)], "entry string")
        got = callgraph.reachable_paths(e, starts)
        assert {x.rsplit("-", 1)[0] for x in names() - before} == {"reach"} and got.count() == 2
    assert names() == before
