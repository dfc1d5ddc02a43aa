"""Merkle manifest, source mixing and hard negatives against plain loops, with odd rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import hardnegatives, merkle, mixing
from factloom.llm.common import cut, work_dir
from factloom.llm.ranking import running_sums

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def odd_docs(spark, n=400):
    """A hot source, sources of one row, null and empty fields, repeated rows, null ids, a clashing column."""
    rng = random.Random(5)
    rows = [(i, rng.choice(["a\nb", "", None, "naïve ÉÉ\n", "x " * rng.randint(1, 50)]), rng.choice(["en", None]), rng.choice(["hot"] * 5 + ["", "é", "z", None]), rng.choice([1, None])) for i in range(n)]
    rows += [rows[3], rows[3], (None, "p\nq", "en", "hot", 1), (None, None, None, None, None), (7, "other", "en", "hot", 2), (-5, "neg\n", "en", "single", 3)]
    return rows, spark.createDataFrame(rows, DOCS).withColumn("grp", F.lit("clash")).withColumn("size", F.lit("clash")).withColumn("leaf", F.lit("clash")).repartition(5)


def saved(df, path, name):
    df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
    return str(path)


def plain_leaf(row, text=None):
    doc_id, own, lang, source, n_chars = row
    fields = [doc_id, source, lang, n_chars, own if text is None else text]
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain_tree(leaves):
    """The root, and for each leaf its siblings level by level as (before, after)."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, own in enumerate(at):
            run = range(own - own % 3, min(own - own % 3 + 3, len(level)))
            ways[i].append(("".join(level[j] for j in run if j < own), "".join(level[j] for j in run if j > own)))
            at[i] = own // 3
        level = [sha(*level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], ways


def plain_manifest(rows):
    groups = collections.defaultdict(list)
    for row in rows:
        groups["0" if row[3] is None else "1" + row[3]].append(row)
    keys = sorted(groups, key=lambda k: k.encode())
    trees = {}
    for key in keys:
        ordered = sorted(groups[key], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        trees[key] = ordered, *plain_tree([plain_leaf(r) for r in ordered])
    root, above = plain_tree([trees[k][1] for k in keys])
    out = []
    for key, more in zip(keys, above):
        ordered, subroot, ways = trees[key]
        for row, way in zip(ordered, ways):
            way = way + more
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[1] is not None
            folded = plain_leaf(row, row[1].replace("\n", "")) if hit else plain_leaf(row)
            for before, after in way:
                folded = sha(before, folded, after)
            out.append((row[0], plain_leaf(row), subroot, root, sha(*[b + a for b, a in way]), folded, folded == root))
    return out


@pytest.mark.parametrize("depth", [1, 2, merkle.DEPTH])
def test_manifest(spark, tmp_path, monkeypatch, depth):
    """Tiers of one, of two and of seven levels give the tree of a plain loop."""
    monkeypatch.setattr(merkle, "DEPTH", depth)
    rows, df = odd_docs(spark)
    got = merkle.op11_merkle_manifest(spark, saved(df, tmp_path, "documents"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_manifest(rows), key=repr)
    assert not got.filter("verified").isEmpty() and not got.filter("not verified").isEmpty()


def test_manifest_of_few_rows(spark, tmp_path):
    for i, rows in enumerate(([(1, "a\n", "en", "s", 1)], [(1, "a\n", "en", "s", 1), (2, "b", "en", None, 1)])):
        got = merkle.op11_merkle_manifest(spark, saved(spark.createDataFrame(rows, DOCS), tmp_path / str(i), "documents")).collect()
        assert sorted(map(tuple, got)) == sorted(plain_manifest(rows))
    assert merkle.op11_merkle_manifest(spark, saved(spark.createDataFrame([], DOCS), tmp_path / "none", "documents")).count() == 0


def test_manifest_names_the_changed_row(spark):
    """A verifier that has the manifest finds exactly the rows whose fields changed, were cut or grew."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("s").alias("source"))
    leaf = lambda df: df.select("doc_id", "source", merkle.leaf(doc_id=F.col("doc_id"), text=F.col("text")).alias("leaf"))
    made = merkle.manifest(leaf(docs), "source", "doc_id").drop("source")
    later = leaf(docs.withColumn("text", F.when(F.col("doc_id").isin(7, 300), F.concat("text", F.lit(" "))).otherwise(F.col("text")))).select("doc_id", F.col("leaf").alias("now"))
    wrong = made.join(later, "doc_id").filter(merkle.fold(F.col("now"), F.col("levels")) != F.col("root"))
    assert sorted(r["doc_id"] for r in wrong.collect()) == [7, 300]


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("aaab"), rng.randint(0, 9)) for i in range(2000)]
    df = cut(spark.createDataFrame(rows, "i int, g string, v long"), "rows")
    got = {r["i"]: (r["s_before"], r["s_total"]) for r in running_sums(df, "g", [F.desc("i")], {"s": F.col("v")}).collect()}
    for i, g, _ in rows:
        assert got[i] == (sum(v for j, h, v in rows if h == g and j > i), sum(v for _, h, v in rows if h == g))


def plain_targets(sizes, weights):
    """Weights in order of the names; the excess is shared anew until no source is above twice its size."""
    names = sorted(sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, free = {}, set(names)
    while True:
        left, total = 1.5 * sum(sizes.values()) - sum(fixed.values()), sum(weight[s] for s in free)
        share = {s: weight[s] * left / total for s in free}
        above = [s for s in free if share[s] > 2 * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in above}
        free -= set(above)


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 1000, 100000]) * rng.randint(1, 9) for i in range(n)}
        sizes["s00"] = 50
        got = {r["src"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "src string, source_size long")).collect()}
        want = plain_targets(sizes, mixing.WEIGHTS)
        assert got == pytest.approx(want)
        assert sum(got.values()) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix(spark, tmp_path):
    rows, df = odd_docs(spark, 1500)
    path = saved(df, tmp_path, "documents")
    got, again = (sorted((tuple(r) for r in mixing.op12_source_mixing(spark, path).collect()), key=repr) for _ in range(2))
    assert got == again and len(got) == len(rows)
    sizes = collections.defaultdict(int)
    for row in rows:
        sizes[("1" if row[3] is None else "0" + row[3])] += len((row[1] or "").split())
    want = plain_targets(sizes, mixing.WEIGHTS)
    taken, largest = collections.defaultdict(int), collections.defaultdict(int)
    for doc_id, size, source_size, target, words, n in got:
        assert words == n * size and 0 <= n <= 2
        taken[source_size, target] += words
        largest[source_size, target] = max(largest[source_size, target], size)
    for source, target in want.items():
        (key,) = [k for k in taken if k[0] == sizes[source] and k[1] == pytest.approx(target)]
        assert abs(taken[key] - target) <= largest[key]


def test_mix_is_random_and_whole(spark):
    """A document's copies follow the rate whatever the seed; the mix holds each document as often as the plan says."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 17 + 1).alias("size"), F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("source"), F.lit(9).alias("copy_number"))
    seen = collections.Counter()
    for seed in range(12):
        plan = mixing.copies(docs, seed=str(seed))
        per = plan.groupBy("source").agg(F.sum("copies").alias("n"), F.count("*").alias("docs"), F.first("source_size").alias("all"), F.first("target").alias("t")).collect()
        assert all(abs(r["n"] - r["docs"] * r["t"] / r["all"]) < 1 for r in per)
        seen.update({r["doc_id"]: r["copies"] for r in plan.collect()})
    assert len({c for c in seen.values()}) > 2
    mix = mixing.mixture(docs, plan)
    assert mix.columns == ["doc_id", "size", "source", "copy_number"]
    assert {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()} == {r["doc_id"]: r["copies"] for r in plan.filter("copies > 0").collect()}
    assert mixing.copies(docs.limit(0)).count() == 0 and mixing.copies(docs.withColumn("size", F.lit(0))).agg(F.sum("copies")).first()[0] == 0


def plain_negatives(rows):
    own = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((vec_id, [math.floor(256 * x) for x in v], (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    clip = lambda x: min(max(x, -(2**63)), 2**63 - 1)
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(own):
        if a is None or a % 100:
            continue
        scored = [(clip(sum(x * y for x, y in zip(v, w))), b, other == label) for j, (b, w, other) in enumerate(own) if j != i]
        positives = sorted((s for s in scored if s[2]), key=order)[:5]
        negatives = sorted((s for s in scored if not s[2]), key=order)
        for p in positives:
            fits = [s for s in negatives if 80 * p[0] <= 100 * s[0] <= 100 * p[0]][:5]
            out += [(a, p[1], rank, s[1], p[0], s[0]) for rank, s in enumerate(fits, 1)]
    return out


@pytest.mark.parametrize("tile", [3, hardnegatives.TILE_ROWS])
def test_negatives(spark, tmp_path, monkeypatch, tile):
    """Several blocks and tiles, groups of equal vectors, nulls, non-finite, short, empty and huge vectors, repeated and null ids."""
    monkeypatch.setattr(hardnegatives, "BLOCK_ROWS", 150)
    monkeypatch.setattr(hardnegatives, "BLOCK_ANCHORS", 3)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 20))
    rows = [(int(i), (centres[rng.integers(6)] + 0.2 * rng.normal(size=20)).astype(float).tolist(), int(rng.integers(4))) for i in range(900)]
    rows += [(1000 + i, rows[0][1], i % 4) for i in range(60)]
    rows += [(100, rows[5][1], 2), (None, rows[6][1], 1), (None, [0.5], 1), (2000, [], 1), (2001, [1.0, None], 1), (2002, [float("nan")], 1), (2003, [float("inf")], 1), (2004, None, 1), (2005, [1.0], None), (2100, [0.0] * 20, 3), (2200, [1e30, -1.0], 3), (2300, [1e30], 2), (2400, [0.25] * 25, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("rid", F.lit("clash")).withColumn("windows", F.lit(0)).repartition(4)
    monkeypatch.setattr(hardnegatives, "TILE_ROWS", tile)
    got = hardnegatives.op13_hard_negatives(spark, saved(df, tmp_path, "embeddings")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_negatives(rows), key=repr)
    assert hardnegatives.hard_negatives(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold_and_exclude():
    """Every level's bounds contain the score, finer ones are tighter, and similar vectors are told from others before the exact score."""
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(50, 64)) + 1, rng.normal(size=(70, 64)) - 1
    sa, sb = hardnegatives.summaries(a).astype(float), hardnegatives.summaries(b).astype(float)
    n, at, before = sum(hardnegatives.SEGMENTS), 0, None
    exact = a @ b.T
    for count in hardnegatives.SEGMENTS:
        span = slice(at, at + count)
        middle, rest = sa[:, :n][:, span] @ sb[:, :n][:, span].T, sa[:, n:][:, span] @ sb[:, n:][:, span].T
        assert (np.abs(exact - middle) <= rest + 1e-3).all()
        assert before is None or (rest <= before + 1e-3).all()
        before, at = rest, at + count
    assert (middle + rest < 0).mean() > 0.9


def test_nothing_is_left_behind(spark, tmp_path):
    """Only the results stay in the shared folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{work_dir(spark)}/factloom")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {str(f.getPath().getName()) for f in files.listStatus(path)} if files.exists(path) else set()
    _, df = odd_docs(spark, 50)
    before = names()
    merkle.op11_merkle_manifest(spark, saved(df, tmp_path, "documents"))
    mixing.op12_source_mixing(spark, str(tmp_path))
    assert sorted(x.rsplit("-", 1)[0] for x in names() - before) == ["merkle-manifest", "mix-copies"]
