"""Reachability over several blocks and groups against a plain search, and flows that are not written whole."""

import collections
import random

import pytest

from factloom.operators import callgraph, lineage
from factloom.plans import call_queries


def search(edges, entry, depth):
    """Breadth-first by the edges' order."""
    way, front = {entry: [entry]}, collections.deque([entry])
    while front:
        at = front.popleft()
        if len(way[at]) <= depth:
            for _, dst in sorted((o, d) for s, d, o in edges if s == at):
                if dst not in way:
                    way[dst] = [*way[at], dst]
                    front.append(dst)
    return way


@pytest.mark.parametrize("targets", [None, ["n3", "n11", "n40"]])
def test_blocks_and_groups(spark, monkeypatch, targets):
    monkeypatch.setattr(callgraph, "HELD_BITS", 64)
    monkeypatch.setattr(callgraph, "GROUP_EDGES", 100)
    pick = random.Random(9)
    edges = [(f"n{pick.randrange(200)}", f"n{pick.randrange(200)}", o) for o in pick.sample(range(1000), 420)]
    rows = callgraph.reachable_paths(spark.createDataFrame(edges, "src string, dst string, ord long"), spark.createDataFrame([(f"n{i}",) for i in range(0, 200, 20)], "entry string"), 5, spark.createDataFrame([(t,) for t in targets], "node string") if targets else None)
    got = {(r["entry"], r["node"]): r["path"] for r in rows.collect()}
    assert got == {(f"n{i}", node): path for i in range(0, 200, 20) for node, path in search(edges, f"n{i}", 5).items() if targets is None or node in targets}


def test_no_row_for_each_edge(spark, monkeypatch):
    written, write = [], callgraph.kept

    def kept(df, name, **options):
        found = write(df, name, **options)
        written.extend([found.count()] if name == "reach-ways" else [])
        return found

    monkeypatch.setattr(callgraph, "kept", kept)
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", a * 30 + b) for a in range(30) for b in range(30) if a != b], "src string, dst string, ord int")
    rows = callgraph.reachable_paths(edges, edges.selectExpr("src AS entry").distinct()).collect()
    assert len(rows) == 900 and sum(written) <= 30


def test_flows_meet_few_endpoints_and_usages_in_place(spark):
    reachable = spark.createDataFrame([("a", "b", ["a", "b"])], "entry string, node string, path array<string>")
    flows = lineage.endpoint_flows(spark.createDataFrame([("/a", "a")], "endpoint_path string, entry string"), reachable, spark.createDataFrame([("b", "s", ["t"])], "owner string, statement string, tables array<string>"))
    assert [r[:] for r in flows.collect()] == [("/a", "a", "a -> b", "b", "s", "t")] and "SortMergeJoin" not in flows._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def flows(spark, monkeypatch):
    """Flows from a query's plan, which may not be written whole, and no chains beside them."""
    rows = spark.createDataFrame([(f"/{i:03}", f"{i:03}", f"{i:03} -> b", "b", "s", "t") for i in range(120)], "endpoint_path string, handler string, code_path string, owner string, statement string, tables string")
    monkeypatch.setattr(call_queries, "_flows", lambda *_: (rows, None, None))
    monkeypatch.setattr(call_queries, "kept", lambda df, name, **_: pytest.fail(f"{name} written"))
    monkeypatch.setattr(call_queries.D, "call_chains", lambda *_: pytest.fail("chains walked"))


def test_flow_graph_reads_flows_in_place(spark, flows):
    got = {r[:] for r in call_queries.flow_graph(spark, "").collect()}
    assert ("", "omitted", "40") in got and ("/079", "calls", "079") in got and ("/080", "calls", "080") not in got and len(got) == 163


def test_flow_nodes_reads_flows_in_place(spark, flows):
    assert collections.Counter(r["kind"] for r in call_queries.flow_nodes(spark, "").collect()) == {"endpoint": 80, "method": 81, "sql": 1, "table": 1}


def test_capped_flows_reads_flows_in_place(spark, flows):
    rows = call_queries.capped_flows(spark, "").collect()
    assert len(rows) == 101 and [r["omitted"] for r in rows if r["place"] is None] == [20]
