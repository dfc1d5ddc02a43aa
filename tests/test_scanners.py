"""Scanners as table functions, and the scanners of client calls."""

import pytest
from conftest import SF, same
from pyspark.sql import functions as F

from factloom.operators import routes
from factloom.plans import catalogue
from factloom.sources import scanners


def test_any_scanner_by_name(spark):
    """The same query takes another scanner; null and empty texts reach it, and other columns stay, whatever they are called."""

    class Shout:
        def eval(self, text):
            if text is not None:
                yield text.upper(),

    files = spark.createDataFrame([("a", "x\n\n 12 y 7\r\n", 1), ("b", None, 2), ("c", "", 3)], "path string, content string, item_no int")
    query = lambda name: [tuple(r) for r in scanners.scan(files, name).orderBy("path", F.lit(1)).collect()]
    scanners.register(spark, "a_scanner", scanners.Lines, scanners.ITEMS)
    assert sorted(query("a_scanner")) == [("a", 1, 0, 1, "x", 1), ("a", 1, 1, 3, "12 y 7", 6)]
    scanners.register(spark, "a_scanner", scanners.Numbers, scanners.ITEMS)
    assert sorted(query("a_scanner")) == [("a", 1, 0, 3, "12", 2), ("a", 1, 1, 3, "7", 1)]
    scanners.register(spark, "shout", Shout, "said string")
    assert sorted(query("shout")) == [("a", 1, "X\n\n 12 Y 7\r\n"), ("c", 3, "")]
    with pytest.raises(ValueError, match="no name"):
        scanners.register(spark, "a; drop", Shout, "said string")


@pytest.mark.parametrize("text, found", [
    ("get('a\\\\'); get('b')", [("get", "a\\\\", "get('a\\\\')"), ("get", "b", "get('b')")]),  # an escaped backslash ends the quote
    ("get('a\\'b', x)", [("get", "a\\'b", "get('a\\'b', x)")]),
    ("f(g('in'), ')')", [("g", "in", "g('in')")]),
    ("f('x', g(`y)`, [1, (2)]))", [("f", "x", "f('x', g(`y)`, [1, (2)]))"), ("g", "y)", "g(`y)`, [1, (2)])")]),
    ("f('never closed", []), ("f('x', 'open", [("f", "x", "f('x', 'open")]), ("// don't\nf('x')", [("f", "x", "f('x')")]), ("a.b.c ( 'x' )", [("a.b.c", "x", "a.b.c ( 'x' )")]),
])
def test_calls(text, found):
    assert [(c, u, e) for _, c, u, e, _ in routes.ApiCalls().eval(text)] == found


def test_long_calls_without_an_end():
    (row,) = routes.ApiCalls().eval("f('x'" + "y" * 1000)
    assert row[3] == "f('x'" + "y" * 301
    assert list(routes.ApiCalls().eval("f('x'" + "(" * 20000)) and list(routes.ApiCalls().eval(None)) == []


@pytest.mark.parametrize("text, found", [
    ("function a() { fetch(u) }", [("a", "GET")]), ("function a() { s = 'x\\\\'; fetch(u, {method: 'put'}) }", [("a", "PUT")]), ("function a() { s = '}'; fetch(u) }\nfunction b() { s = \"fetch(\" + '{' }", [("a", "GET"), ("b", "GET")]),
    ("function a() { x }  fetch(u)", []), ("function a() { fetch(u, {method: \"Patch\"})", [("a", "PATCH")]), ("function a() {" + " " * 900 + "fetch(u)", []), ("function a()", []),
    ("function a() { fetch(u) } function a() { fetch(u, { method: 'delete' }) }", [("a", "DELETE")]), ("function f<T>(x = {}) { fetch(x) }", []),
])
def test_helpers(text, found):
    assert list(routes.Helpers().eval(text)) == found


@pytest.mark.parametrize("name", ["scan_lines", "scan_numbers"])
def test_scanner_queries(spark, name):
    same(catalogue.QUERIES[name](spark, SF), catalogue.SQL[name])
