"""Edges with properties and labels, default rows, chunk families of a source, chunk layouts."""

import pytest

from factloom.operators import assets, chunking, fusion, graph, report


def test_refresh(spark):
    ddl = "tenant string, src string, type string, dst string, props map<string,string>"
    old = spark.createDataFrame([("a", "x", "E", "1", {"n": "old"}), ("a", "x", "E", "2", {}), ("b", "y", "E", "1", {"n": "b"})], ddl)
    new = spark.createDataFrame([("a", "x", "E", "1", {"n": "new"}), ("a", "x", "E", "3", None), ("b", "y", "E", "9", {})], ddl)
    due = lambda *t: spark.createDataFrame([(x,) for x in t], "tenant string")
    got = lambda df: {(r["tenant"], r["dst"], r["state"], (r["props"] or {}).get("n")) for r in df.collect()}
    assert got(graph.refresh_edges(old, new, due("a", "a"))) == {("a", "1", "kept", "new"), ("a", "2", "dropped", None), ("a", "3", "added", None), ("b", "1", "kept", "b")}
    assert got(graph.refresh_edges(old, new.limit(0), due("b"))) == {("a", "1", "kept", "old"), ("a", "2", "kept", None), ("b", "1", "dropped", "b")}
    assert got(graph.refresh_edges(old.limit(0), new, due("b"))) == {("b", "9", "added", None)}


def test_asset_edges(spark):
    own = spark.createDataFrame([("k", "p"), ("k", "p"), ("z", "q")], "id string, project_id string")
    links = spark.createDataFrame([("k", "r", 1, None), ("k", "r", 1, None), ("nobody", "r", 2, "x")], "asset_id string, key string, line int, note string")
    got = sorted((r["tenant"], r["src"], r["type"], r["dst"], tuple(r["props"].items())) for r in graph.asset_edges(own, links).collect())
    assert got == [("p", "k", "EVIDENCED_BY", "r", (("line", "1"),)), ("p", "p", "HAS_KNOWLEDGE_ASSET", "k", ()), ("q", "q", "HAS_KNOWLEDGE_ASSET", "z", ())]


def test_ends_by_label(spark):
    nodes = spark.createDataFrame([("p", "project"), ("f", "file"), ("r", "record"), ("k", "asset")], "id string, label string")
    edges = spark.createDataFrame([("p", "A", "f"), ("k", "B", "r"), ("r", "C", "p"), ("f", "D", "r"), ("f", "E", "nobody")], "src string, type string, dst string")
    assert {r["type"] for r in graph.between(edges, nodes).collect()} == {"A", "D"}


def test_defaults_and_families(spark):
    rows = spark.createDataFrame([("a", "own")], "tenant string, kind string")
    tenants = spark.createDataFrame([("a",), ("b",)], "tenant string")
    got = assets.with_defaults(rows, spark.createDataFrame([("x",), ("y",)], "kind string"), tenants, "tenant").collect()
    assert sorted(map(tuple, got)) == [("a", "own"), ("b", "x"), ("b", "y")]
    code, kb = (spark.createDataFrame([(x,)], "id string") for x in ("code", "kb"))
    assert [sorted(r["id"] for r in chunking.source_chunks(mode, code, kb).collect()) for mode in ("code", "kb", "mixed")] == [["code"], ["kb"], ["code", "kb"]]
    with pytest.raises(ValueError, match="unknown source"):
        chunking.source_chunks("other", code, kb)


def test_layouts(spark):
    """Parameters, constructors, missing types, empty values and lines that end with a colon and a blank."""
    ddl = "type string, file_path string, package string, symbol_name string, enclosing_type string, enclosing_method string, start_line int, ord int, payload string"
    rows = [
        ("method", "A.java", "p", "run", "A", "", 3, 0, '{"name":"run","kind":"method","enclosing_type":"A","parameters":[{"name":"x","type":"int"},{"name":"y"}]}'), ("method", "A.java", "p", "run", "A", "", 9, 1, '{"name":"run","kind":"method","enclosing_type":"A"}'),
        ("call", "A.java", "p", "B", "A", "run", 4, 1, '{"name":"B","kind":"constructor","arguments":["1","x"]}'), ("call", "A.java", "p", "f", "A", "run", 4, 0, '{"name":"f"}'), ("local_variable", "A.java", "p", "v", "A", "run", 4, 0, '{"name":"v"}'),
        ("return", "A.java", "p", "", "A", "run", 5, 0, '{"expression":"v"}'), ("return", "A.java", "p", "", "A", "run", 6, 1, "{}"), ("control_structure", "A.java", "p", "", "A", "run", 6, 0, '{"kind":"if","condition":"x"}'),
        ("endpoint", "", None, "get", "A", "", 3, 0, '{"method_name":"get","enclosing_type":"A","http_methods":["GET","PUT"],"path":"/u","parameters":[{"source":"path","name":"id"},{"source":"query","name":"q","alias":"word"}]}'),
        ("sql_reference", "A.java", "", "", "A", "", 3, 0, '{"operation":"select","enclosing_type":"A","statement":"odd: "}'),
    ]
    facts = spark.createDataFrame(rows, ddl)
    got = {r["id"]: r["text"] for r in chunking.chunk_methods(facts).collect()}
    body = "\nCalls: f, new B(1, x)\nLocal variables: ? v\nReturns: v; \nControl flow: if(x)"
    head = "Java method run\nPackage: p\nFile: A.java\nEnclosing type: A"
    assert got == {"A.java::method::run::3": f"{head}\nParameters: int x, ? y{body}", "A.java::method::run::9": head + body}
    got = {r["id"]: r["text"] for r in chunking.chunk_facts(facts).collect()}
    assert got == {"<memory>::endpoint::A.get::3": "Java HTTP endpoint GET, PUT /u\nController: A\nMethod: get\nParameters: path:id, query:word", "A.java::sql::A.select::3": "Java SQL select \nEnclosing type: A\nFile: A.java"}


def test_titles_and_locations(spark):
    ddl = "id string, title string, symbol_name string, doc_name string, section string, kind string, file_path string, start_line int, text string, source_type string"
    empty = ("", None, "", None, "")
    rows = [(str(i), *empty[:i], *(["t"] if i < 5 else []), *["later"] * (4 - i), *where, "x", "kb") for i, where in enumerate([("p", 3), ("p", 0), ("p", None), ("", 3), (None, 3), ("p", 7)])]
    items = spark.createDataFrame([(1, i + 1, str(i), 0.5) for i in range(6)], "query_id int, n int, id string, score double")
    got = [(r["title"], r["location"]) for r in report.citations(items, spark.createDataFrame(rows, ddl)).orderBy("n").collect()]
    assert got == [("t", "p:3"), ("t", "p"), ("t", "p"), ("t", ""), ("t", ""), ("fragment", "p:7")]


def test_anchor_fields(spark):
    """A record that shares only a hit's symbol is found."""
    hits = spark.createDataFrame([(1, 1, "h", "zebra", "yak", "code", "loadUserData", None)], "query_id int, rank int, id string, query string, text string, source_type string, symbol_name string, section string")
    records = spark.createDataFrame([("r", 1, "about user data", "k", "f", "kb", "s"), ("h", 2, "yak", "k", "f", "code", "s"), ("o", 3, "nothing", "k", "f", "kb", "s")], "id string, ord int, text string, kind string, file_path string, source_type string, status string")
    assert [(r["id"], r["overlap"]) for r in fusion.related_candidates(hits, records).collect()] == [("r", 2)]


def test_unknown_projects(spark):
    wanted = spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "user_id int, project_id string")
    assert sorted(r["user_id"] for r in assets.unknown_projects(wanted, spark.createDataFrame([("p",), ("p",)], "project_id string")).collect()) == [2, 3]
