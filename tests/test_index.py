"""The versioned index: rebuilds, appends, replays, interrupted builds, pruned scans and pages."""

import pytest

from factloom.sources import index


def rows(spark, *found):
    return spark.createDataFrame(list(found), "id string, project string, n int, source_type string")


def state(spark, path, **more):
    return sorted((r["tenant"], r["id"], r["n"]) for r in index.read(spark, path, **more).collect())


def test_builds(spark, tmp_path):
    path = str(tmp_path / "index")
    assert index.build(rows(spark, ("a", "007", 1, "kb"), ("b", "007", 1, "kb"), ("a", "7", 1, "kb"), ("c", "x/y =z", 1, "code"), ("d", None, 1, "kb"), ("e", "", 1, "kb")), path, "project", "one") == 1
    assert state(spark, path) == [("007", "a", 1), ("007", "b", 1), ("7", "a", 1), ("x/y =z", "c", 1)]
    assert index.build(rows(spark, ("a", "007", 2, "kb"), ("z", "new", 2, "kb")), path, "project", "two", append=True) == 2
    after = [("007", "a", 2), ("007", "b", 1), ("7", "a", 1), ("new", "z", 2), ("x/y =z", "c", 1)]
    assert state(spark, path) == after
    assert index.build(rows(spark, ("q", "007", 9, "kb")), path, "project", "two", append=True) == 2 and state(spark, path) == after  # a replay
    assert index.build(rows(spark, ("b", "007", 3, "kb")), path, "project", "three", tenants=spark.createDataFrame([("7",), ("nobody",)], "tenant string")) == 3
    assert state(spark, path) == [("007", "b", 3), ("new", "z", 2), ("x/y =z", "c", 1)]
    assert state(spark, path, version=2) == after  # a reader of the old version still sees it whole
    assert state(spark, path, tenants=["007", "x/y =z"]) == [("007", "b", 3), ("x/y =z", "c", 1)]
    assert index.build(rows(spark), path, "project", "none") == 4 and len(state(spark, path)) == 3
    assert index.vacuum(spark, path) == 4 and len(state(spark, path)) == 3
    assert index.build(rows(spark), path, "project", "all gone", tenants=index.manifest(spark, path).select("tenant")) == 5 and state(spark, path) == []


def test_interrupted_build(spark, tmp_path):
    """Parts without a manifest, and a manifest that was not finished, are not seen; the build can be repeated."""
    path = str(tmp_path / "index")
    index.build(rows(spark, ("a", "p", 1, "kb")), path, "project", "one")
    two = rows(spark, ("a", "p", 2, "kb"), ("b", "p", 2, "kb"))
    index.build(two, path, "project", "two")
    (tmp_path / "index/manifests/version=2/_SUCCESS").unlink()
    assert index.versions(spark, path) == [1] and state(spark, path) == [("p", "a", 1)]
    assert index.build(two, path, "project", "two") == 2 and state(spark, path) == [("p", "a", 2), ("p", "b", 2)]


def test_scan_is_pruned(spark, tmp_path):
    path = str(tmp_path / "index")
    for name in ("one", "two"):
        index.build(rows(spark, *[(f"r{i}", f"t{i % 5}", i, "kb") for i in range(50)]), path, "project", name)
    plan = index.read(spark, path, ["t3"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_tenant" in plan and "= t3" in plan and "DataFilters: []" in plan


def test_pages(spark, tmp_path):
    path = str(tmp_path / "index")
    index.build(rows(spark, *[(f"r{i:02d}", "t", i, "code" if i % 3 else "kb") for i in range(25)]), path, "project", "one")
    found, last = [], None
    while part := [r["id"] for r in index.page(index.read(spark, path, ["t"]), "id", last, 4, "code").collect()]:
        found, last = found + part, part[-1]
    assert found == [f"r{i:02d}" for i in range(25) if i % 3]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.read(spark, str(tmp_path / "nothing"))
