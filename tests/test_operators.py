"""Edge cases of the library's operators on small hand-written rows."""

import random
import re
import uuid

import pytest
from pyspark.sql import functions as F

from factloom.operators import assets, callgraph, chunking, facts, fusion, lineage, report, routes, search
from factloom.sources import corpus, state
from factloom.streaming import incremental


@pytest.mark.parametrize("text, parts", [
    ("", [""]), ("short", ["short"]), ("a" * 25, ["a" * 10, "a" * 10, "a" * 5]), ("aa\n\nbb\n\n\ncc", ["aa\n\nbb", "cc"]), ("aaa\n\nbbb\n \ncccccc", ["aaa\n\nbbb", "cccccc"]),
    ("aa\n\n" + "b" * 12 + "\n\ncc", ["aa", "bbbbbbbbbb", "bb", "cc"]), ("\n\n   \n\n" + " " * 10, []),
])
def test_pack_paragraphs(spark, text, parts):
    """Written by hand: a text that fits stays, paragraphs fill parts of ten characters in order, over-long ones are cut."""
    assert spark.createDataFrame([(text,)], "text string").select(chunking.pack_paragraphs(F.col("text"), 10).alias("p")).first()["p"] == parts


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n# One\ntext\n\n## Two\nmore\n"), (2, "# Only"), (3, ""), (4, "\n\n# Late\nx")], "id int, text string")
    got = {(r["id"], r["title"], r["start_line"], r["end_line"]) for r in chunking.split_sections(df).collect()}
    assert got == {(1, "document", 1, 1), (1, "One", 2, 4), (1, "Two", 5, 6), (2, "Only", 1, 1), (4, "Late", 3, 4)}


def test_chains_and_paths(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 3), ("d", "a", 4), ("c", "d", 5)], "src string, dst string, ord long")
    entries = spark.createDataFrame([("a",)], "entry string")
    chains = [r["chain"] for r in callgraph.call_chains(edges, entries).orderBy("n").collect()]
    assert chains == ["a -> b -> d -> a", "a -> c -> d -> a"]
    assert [r["chain"] for r in callgraph.call_chains(edges, entries, max_chains=1).collect()] == ["a -> b -> d -> a"]
    found = {r["node"]: r["path"] for r in callgraph.reachable_paths(edges, entries).collect()}
    assert found == {"a": ["a"], "b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}


def test_usages_from_xml(spark):
    good = '<?xml version="1.0"?>\n<mapper namespace="x.y.UserMapper">\n<select id="find">select * from users\n where id = 1</select><insert id="">x</insert></mapper>'
    files = spark.createDataFrame([("a.xml", good), ("b.xml", "<mapper"), ("c.xml", "<other/>")], "path string, content string")
    rows = [tuple(r) for r in lineage.usages_from_xml(files).collect()]
    assert rows == [("UserMapper", "find", "select", "select * from users where id = 1", "a.xml", 3)]


def test_extract_tables(spark):
    text = "SELECT * FROM `users` u JOIN db.orders o ON 1 update set x from users where afrom nothing"
    assert spark.range(1).select(lineage.extract_tables(F.lit(text)).alias("t")).first()["t"] == ["users", "db.orders"]


def test_routes(spark):
    calls = spark.createDataFrame([(1, "GET", "/api/users/{id}"), (2, "POST", "/users/1"), (3, "GET", "/none")], "call_id int, method string, path string")
    ends = spark.createDataFrame([("e", 1, ["GET"], "/users/{id}")], "endpoint_id string, ord int, methods array<string>, path string")
    got = {r["call_id"]: (r["status"], r["strategy"]) for r in routes.map_routes(calls, ends).collect()}
    assert got == {1: ("matched", "api_prefix_stripped"), 2: ("method_mismatch", "direct"), 3: ("unmatched", "none")}
    method = routes.infer_method(F.col("c"), F.col("e"), F.col("h"))
    rows = spark.createDataFrame([("axios.get", "", None), ("fetch", "fetch('/x', {method: 'put'})", None), ("go", "", "PATCH"), ("fetch", "", None), ("call", "", None)], "c string, e string, h string")
    assert [r[0] for r in rows.select(method).collect()] == ["GET", "PUT", "PATCH", "GET", "UNKNOWN"]


def test_uuid5(spark):
    got = spark.range(1).select(state.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.lit("p:é")).alias("u")).first()["u"]
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, "p:é"))


@pytest.mark.parametrize("titles, existing, slugs", [
    (["a", "a", "a-2"], [], ["a", "a-2", "a-2-2"]), (["a-2", "a"], ["a-2", "a"], ["a-2-2", "a-3"]), (["A b!", "a B", "", "", "a-b-3", "a b"], ["a-b"], ["a-b-2", "a-b-3", "item", "item-2", "a-b-3-2", "a-b-4"]),
    (["x", "x", "x"], [], ["x", "x-2", "x-3"]), ([], ["x"], []),
])
def test_slugs(spark, titles, existing, slugs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "ord long, title string")
    got = assets.unique_slugs(df, "title", "ord", spark.createDataFrame([(e,) for e in existing], "slug string")).orderBy("ord").collect()
    assert [r["slug"] for r in got] == slugs


def test_headers(spark):
    df = spark.createDataFrame([("a", "package x.y;\nimport static a.B.c;\nimport d.*;\n"), ("b", "")], "path string, content string")
    got = {(r["path"], r["package"], r["name"], r["is_static"], r["is_wildcard"]) for r in facts.scan_headers(df).collect()}
    assert got == {("a", "x.y", "a.B.c", True, False), ("a", "x.y", "d", False, True), ("b", "", None, None, None)}


def test_cosine_needs_equal_lengths(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(search.cosine(F.col("a"), F.col("b"))).first()[0] == 1.0
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(search.cosine(F.col("a"), F.col("b"))).collect()


def test_model_embed(spark):
    df = spark.createDataFrame([("x", "aa"), ("y", None)], "id string, text string")
    got = {r["id"]: r["embedding"] for r in search.model_embed(df, lambda: lambda texts: [[len(t), 0.0] for t in texts], 2).collect()}
    assert got == {"x": [1.0, 0.0], "y": [0.0, 0.0]}


def test_excerpt(spark):
    got = spark.createDataFrame([("a  b\n c",), ("x" * 200,)], "t string").select(report.excerpt(F.col("t"))).collect()
    assert got[0][0] == "a b c" and got[1][0] == "x" * 180 + "..."


def test_write_replace_and_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    one = spark.createDataFrame([("p", 1), ("q", 2)], "project_id string, x int")
    state.write_replace(one, path, ["project_id"])
    state.write_replace(spark.createDataFrame([("p", 9)], "project_id string, x int"), path, ["project_id"])
    assert {(r["project_id"], r["x"]) for r in spark.read.parquet(path).collect()} == {("p", 9), ("q", 2)}
    (tmp_path / "src" / "dist").mkdir(parents=True)
    (tmp_path / "src" / "guide.md").write_text("# A")
    (tmp_path / "src" / "dist" / "report.md").write_text("# B")
    (tmp_path / "src" / "x.py").write_text("no")
    got = corpus.scan_corpus(spark, str(tmp_path / "src"), corpus.DOCUMENTS, corpus.SKIPPED_DOCUMENTS).collect()
    assert [(r["path"].rsplit("/", 1)[1], r["content"]) for r in got] == [("guide.md", "# A")]


def test_streams(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, seq long, text string").write.parquet(src)
    stream = lambda: spark.readStream.schema("id string, seq long, text string").parquet(src)
    incremental.stream_upsert(stream(), out, check, ["id"], ["seq"]).awaitTermination(60)
    spark.createDataFrame([("a", 2, "z")], "id string, seq long, text string").write.mode("append").parquet(src)
    incremental.stream_upsert(stream(), out, check, ["id"], ["seq"]).awaitTermination(60)
    got = {r["id"]: r["text"] for r in incremental.read_keyed(spark, out, ["id"], ["seq"]).collect()}
    assert got == {"a": "z", "b": "y"}


def test_scan_api_calls(spark):
    text = "import x\naxios.get('/api/users/' + (id))\nfetch(`/api/a`, {method: 'POST',\n body: f(\")\")})\nplain(1)\nopen('/x'"
    files = spark.createDataFrame([("a.vue", text), ("b.vue", None)], "path string, content string")
    got = [(r["callee"], r["url"], r["line"], r["expression"]) for r in routes.scan_api_calls(files).orderBy("ord").collect()]
    assert got == [
        ("axios.get", "/api/users/", 2, "axios.get('/api/users/' + (id))"), ("fetch", "/api/a", 3, "fetch(`/api/a`, {method: 'POST', body: f(\")\")})"),
        ("f", ")", 4, 'f(")")'), ("open", "/x", 6, "open('/x'"),
    ]


def test_helpers_and_type_arguments(spark):
    text = "function save(u: User) { return fetch(u, { method: 'put', x: '}' }) }\nasync function load<T>(u) { return fetch(u) }\nconst plain = () => { return 1 }\nrequest<User>('/api/u')\nsave('/api/s')\nload<A<B>>(`/api/l`)\nhttp.post('/api/p')"
    files = spark.createDataFrame([("a.ts", text), ("b.ts", "save('/api/b')"), ("c.ts", None)], "path string, content string")
    calls = routes.with_methods(routes.scan_api_calls(files), routes.scan_helpers(files))
    got = {(r["path"], r["callee"], r["url"], r["method"]) for r in calls.collect()}
    assert got == {("a.ts", "request", "/api/u", "UNKNOWN"), ("a.ts", "save", "/api/s", "PUT"), ("a.ts", "load", "/api/l", "GET"), ("a.ts", "http.post", "/api/p", "POST"), ("b.ts", "save", "/api/b", "UNKNOWN")}


def test_route_variables_on_both_sides(spark):
    calls = spark.createDataFrame([(1, "/api/{x}/b"), (2, "/a/7"), (3, "/api"), (4, "/a/b/c")], "call_id int, path string")
    ends = spark.createDataFrame([(1, "/a/b"), (2, "/a/{id}"), (3, "/"), (4, "/{p}/{q}"), (5, "/a/<b>/d")], "endpoint_id int, path string")
    got = {(r["call_id"], r["endpoint_id"], r["score"]) for r in routes.route_candidates(calls, ends).collect()}
    assert got == {(1, 1, 3), (1, 2, 2), (1, 4, 2), (2, 2, 3), (2, 4, 2), (3, 3, 0)} | {(1, 5, 3)} - {(1, 5, 3)}


def test_dense_search_edges(spark):
    """Zero and null vectors, ties, empty tables and unequal lengths."""
    ddl, out = "id long, ord long, embedding array<double>", "query_id long, embedding array<double>"
    vectors = spark.createDataFrame([(1, 2, [1.0, 0.0]), (2, 1, [2.0, 0.0]), (3, 3, [0.0, 0.0]), (4, 4, None)], ddl)
    queries = spark.createDataFrame([(7, [3.0, 0.0]), (8, [0.0, 0.0]), (9, None)], out)
    assert {tuple(r) for r in search.dense_search(queries, vectors, 2).collect()} == {(7, 1, 2, 1.0), (7, 2, 1, 1.0), (8, 1, 2, 0.0), (8, 2, 1, 0.0)}
    assert search.dense_search(queries.limit(0), vectors).count() == 0 and search.dense_search(queries, vectors.limit(0)).count() == 0
    with pytest.raises(Exception, match="differ in length"):
        search.dense_search(queries, spark.createDataFrame([(1, 1, [1.0])], ddl)).collect()


def test_search_in_blocks(spark, monkeypatch):
    """Many small blocks and tiles give the rows of one block."""
    rng = random.Random(4)
    rows = lambda n, c: [(i, i, [rng.random() for _ in range(4)], " ".join(rng.choices("abcdefgh", k=5))) for i in range(n)]
    queries = spark.createDataFrame(rows(11, 0), "query_id long, ord long, embedding array<double>, text string")
    vectors = spark.createDataFrame(rows(40, 1), "id long, ord long, embedding array<double>, text string")
    sparse = search.vector_rows(vectors.select("id", "ord", "text"))
    for way in (lambda: search.dense_search(queries, vectors, 3), lambda: search.search(queries.select("query_id", "text"), sparse, 3)):
        monkeypatch.undo()
        whole = sorted(way().collect())
        for name, value in (("BLOCK_QUERIES", 4), ("BLOCK_ROWS", 7), ("FEW_ROWS", 9), ("BLOCK_SCORES", 6)):
            monkeypatch.setattr(search, name, value)
        assert sorted(way().collect()) == whole and len({r[0] for r in whole}) == 11


def test_buckets_in_python_and_in_columns(spark):
    df = spark.createDataFrame([("a", "Get the_Value 42 get é, 0x1F \u212a"), ("b", None), ("c", "")], "id string, text string")
    token = F.explode(search.tokens(F.col("text")))
    want = df.select("id", token.alias("t")).groupBy("id", search.bucket_of(F.col("t")).alias("bucket")).agg(F.sum(search.sign_of(F.col("t")).cast("long")).alias("weight")).filter("weight <> 0")
    assert sorted(search.hash_embed(df).collect()) == sorted(want.collect())
    assert search.vector_rows(df).filter("size(buckets) = 0").count() == 2


@pytest.mark.parametrize("first", [1, 8, 1000])
def test_overlaps(spark, monkeypatch, first):
    """Frequent and rare terms, ties, sides, excluded ids, anchors and records without terms, against a plain count."""
    for name, value in (("FIRST_POSTINGS", first), ("BLOCK_ANCHORS", 7), ("BLOCK_RECORDS", 50), ("FEW_RECORDS", 60), ("PAIRS", 100), ("PAIR_BLOCK", 9)):
        monkeypatch.setattr(fusion, name, value)
    rng = random.Random(first)
    word = lambda: f"t{min(int(rng.paretovariate(0.6)), 400)}"
    records = [(f"r{i}", i % 30, [word() for _ in range(rng.randint(0, 40))] + [None], rng.choice(["c", "k", None])) for i in range(150)] + [("none", 1, None, "c")]
    anchors = [(i, [word() for _ in range(rng.randint(0, 60))], rng.choice(["c", "k", None]), rng.choice([None, ["r1", "r2"], []])) for i in range(40)] + [(99, None, None, None)]
    got = fusion.overlaps(spark.createDataFrame(anchors, "q int, terms array<string>, side string, excluded array<string>"), spark.createDataFrame(records, "id string, ord int, terms array<string>, side string")).collect()
    scores = {}
    for r in got:
        scores.setdefault(r["q"], []).append((r["rank"], r["score"], r["ord"]))
    order = {r[0]: r[1] for r in records}
    for q, own, side, excluded in anchors:
        shared = {i: len(set(own or []) & set(t or []) - {None}) for i, _, t, s in records if (side is None or s != side) and i not in (excluded or [])}
        want = sorted(((n, -order[i]) for i, n in shared.items() if n), reverse=True)[:5]
        assert [(s, -o) for _, s, o in sorted(scores.get(q, []))] == want
        assert all(shared[r["id"]] == r["score"] for r in got if r["q"] == q)
