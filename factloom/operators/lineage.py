"""Lineage from endpoints over calls to statements and tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.work import kept, small


def extract_tables(statement: Column) -> Column:
    """Names after from, join, into or update (one dot at most, quotes stripped), distinct, in order of first occurrence."""
    # fixed value: the pattern
    pattern = r"(?i)(?<![A-Za-z0-9_])(?:from|join|into|update)[\x20\x09-\x0D]+([`\"\[]?[A-Za-z_][A-Za-z0-9_$]*(?:\.[A-Za-z_][A-Za-z0-9_$]*)?[`\"\]]?)"
    names = F.transform(F.regexp_extract_all(statement, F.lit(pattern), F.lit(1)), lambda x: F.regexp_replace(x, r"[`\"\[\]]", ""))
    return F.array_distinct(F.filter(names, lambda x: ~F.lower(x).isin("select", "set", "where")))


def sql_usages(annotations: DataFrame, xml: DataFrame | None = None) -> DataFrame:
    """Usages of both origins in the order (owner, operation, file, line): (owner_type, method, operation, statement, tables, source, file_path, line)."""
    both = annotations.withColumn("source", F.lit("annotation"))
    if xml is not None:
        both = both.unionByName(xml.withColumn("source", F.lit("xml")))
    return both.withColumn("tables", extract_tables(F.col("statement"))).orderBy("owner_type", "method", "operation", "file_path", "line")


def usages_from_annotations(refs: DataFrame, types: DataFrame) -> DataFrame:
    """(owner_type, method, operation, statement, file_path, line) of annotated statements; refs without a type or a method are left out.

    The file is the last one (by ord) that declares the owner, else the reference's own. types: (name, file_path, ord).
    """
    last = types.groupBy(F.col("name").alias("owner_type")).agg(F.max_by("file_path", "ord").alias("declared"))
    named = refs.filter("owner_type <> '' and method <> ''").join(last, "owner_type", "left")
    return named.select("owner_type", "method", "operation", "statement", F.coalesce("declared", "file_path", F.lit("")).alias("file_path"), "line")


def usages_from_xml(files: DataFrame) -> DataFrame:
    """(owner_type, method, operation, statement, file_path, line) of mapper files (path, content); files that do not parse are passed over."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["content"]):
                try:
                    root = ET.fromstring(text)
                except ET.ParseError:
                    continue
                owner = (root.get("namespace") or "").strip().split(".")[-1]
                for e in root.iter():
                    kind, name = str(e.tag).split("}")[-1].lower(), (e.get("id") or "").strip()
                    if kind in ("select", "insert", "update", "delete") and owner and name:
                        at = next((i for i, line in enumerate(text.split("\n"), 1) if f'id="{name}"' in line or f"id='{name}'" in line), 1)
                        rows.append((owner, name, kind, " ".join("".join(e.itertext()).split()), path, at))
            yield pd.DataFrame(rows, columns=["owner_type", "method", "operation", "statement", "file_path", "line"])

    return files.filter(F.contains("content", F.lit("<mapper"))).select("path", "content").mapInPandas(run, "owner_type string, method string, operation string, statement string, file_path string, line int")


def endpoint_flows(endpoints: DataFrame, reachable: DataFrame, usages: DataFrame) -> DataFrame:
    """(endpoint_path, handler, code_path, owner, statement, tables): every usage of every method that an endpoint reaches.

    endpoints: (endpoint_path, entry); reachable: (entry, node, path); usages: (owner, statement, tables) with the node's name as owner.
    """
    return reachable.join(small(endpoints), "entry").join(small(usages), F.col("node") == F.col("owner")).select(
        "endpoint_path", F.col("entry").alias("handler"), F.array_join("path", " -> ").alias("code_path"), "owner", "statement", F.array_join("tables", ",").alias("tables")
    )


def flow_graph(flows: DataFrame, chains: DataFrame | None = None, cap: int = 80, path_cap: int = 160, table_cap: int = 80) -> DataFrame:
    """(src, type, dst): edges of the first ``cap`` flows: endpoint and calls along the path, runs SQL, touches table; each once.

    A flow shows at most ``path_cap`` methods and ``table_cap`` tables; a row of type ``omitted`` tells how many flows are left out, if any
    are. Without a flow, the graph has the calls of ``chains`` (n, entry, chain) in its place.
    """
    place = F.row_number().over(Window.orderBy("endpoint_path", "code_path", "owner", "statement"))
    top = kept(flows.orderBy("endpoint_path", "code_path", "owner", "statement").limit(cap).withColumn("n", place), "top")

    def steps(df, nodes):
        rows = df.select("n", F.posexplode(nodes).alias("i", "node"))
        nxt = F.lead("node").over(Window.partitionBy("n").orderBy("i"))
        return rows.select(F.col("node").alias("src"), F.lit("calls").alias("type"), nxt.alias("dst")).filter("dst is not null")

    calls = steps(top, F.concat(F.array("endpoint_path"), F.slice(F.split("code_path", " -> "), 1, path_cap)))
    runs = top.select(F.element_at(F.slice(F.split("code_path", " -> "), 1, path_cap), -1).alias("src"), F.lit("runs").alias("type"), F.col("statement").alias("dst"))
    touches = top.select(F.col("statement").alias("src"), F.lit("touches").alias("type"), F.explode(F.slice(F.split("tables", ","), 1, table_cap)).alias("dst"))
    left = flows.agg((F.count("*") - cap).alias("n")).filter("n > 0").select(F.lit("").alias("src"), F.lit("omitted").alias("type"), F.col("n").cast("string").alias("dst"))
    found = calls.unionByName(runs).unionByName(touches).unionByName(left)
    if chains is not None:
        plain = steps(chains, F.split("chain", " -> "))
        found = found.unionByName(plain.join(flows.select(F.lit(1).alias("some")).limit(1), F.lit(True), "left_anti"))
    return found.filter("dst <> ''").distinct()


def flow_nodes(flows: DataFrame, cap: int = 80, path_cap: int = 160, table_cap: int = 80) -> DataFrame:
    """(kind, name, number): the distinct nodes of the graph of the first ``cap`` flows. Endpoints and statements are numbered as they are first seen, methods and
    tables by name; a flow shows at most ``path_cap`` methods and ``table_cap`` tables."""
    order = ["endpoint_path", "code_path", "owner", "statement"]
    top = flows.orderBy(*order).limit(cap).withColumn("n", F.row_number().over(Window.orderBy(*order)))
    named = lambda kind, c: F.transform(c, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("name")))
    nodes = top.select("n", F.inline(F.concat(named("endpoint", F.array("endpoint_path")), named("sql", F.array("statement")), named("method", F.slice(F.split("code_path", " -> "), 1, path_cap)), named("table", F.slice(F.split("tables", ","), 1, table_cap)))))
    once = nodes.filter("name <> ''").groupBy("kind", "name").agg(F.min("n").alias("n"))
    seen = F.when(F.col("kind").isin("endpoint", "sql"), F.col("n")).otherwise(0)
    return once.select("kind", "name", F.row_number().over(Window.partitionBy("kind").orderBy(seen, "name")).alias("number"))


def capped(df: DataFrame, order: list[str], n: int = 100) -> DataFrame:
    """The first ``n`` rows with their place, and a row with place null and how many were left out, if any were."""
    top = df.orderBy(*order).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*order))).withColumn("omitted", F.lit(0).cast("long"))
    rest = df.agg((F.count("*") - n).alias("omitted")).filter("omitted > 0")
    return top.unionByName(rest, allowMissingColumns=True)
