"""The pipeline's stages on the smallest tables."""

import os

from conftest import SF

import corpus_pipeline
from factloom.llm import decontaminate, neardup
from factloom.llm.common import cut, keep, scratch, table, work_dir


def test_stages(spark):
    docs = table(spark, SF, "documents")
    names = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == names
    assert seen["quality_rules"].count() < table(spark, SF, "documents").count()
    assert neardup.near_duplicates(seen["near_dedup"]).filter("not kept").count() == 0
    assert decontaminate.contamination(seen["decontamination"], table(spark, SF, "benchmark")).filter(decontaminate.is_contaminated()).count() == 0
    packed = seen["best_fit_packing"]
    assert packed.select("doc_id").distinct().count() == seen["decontamination"].count()
    assert packed.groupBy("bin_id").sum("n_words").filter("bin_id is not null and `sum(n_words)` > 2048").count() == 0


def test_stages_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns; then no rows at all."""
    word = lambda i: "".join(chr(97 + (i * k) % 26) for k in (1, 3, 5, 7, 11))
    prose = lambda a, n: " ".join(f"{word(a + i)}{chr(97 + a % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{chr(97 + i // 17576)}" for i in range(n))
    ddl = "doc_id long, text string, lang string, source string, n_chars long, quality string, ord int, contamination string, cluster long, band string"
    rows = [(1, prose(1, 60)), (2, prose(1, 60)), (2, prose(1, 60)), (None, prose(5, 50)), (3, None), (4, ""), (5, " \n\t"), (6, prose(9, 30_000)), (7, "one"), (8, prose(77, 40) + "\n" + prose(99, 40)), ((1 << 60) + 1, prose(340, 45))]
    full = [(i, t, None if i == 7 else "en", None if i == 1 else "s", None, "x", 1, "y", None, "z") for i, t in rows]
    for docs in (spark.createDataFrame(full, ddl), spark.createDataFrame([], ddl)):
        names = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = cut(stage(spark, docs, SF), name)
            assert name == "best_fit_packing" or docs.columns == names
        ids = [r["doc_id"] for r in docs.select("doc_id").distinct().collect()]
        assert not ids or {1, 6, 8, (1 << 60) + 1} <= set(ids) and not {2, 3, 4, 5, 7} & set(ids)


def test_run_is_repeatable(spark):
    """Two runs agree, and each leaves one table in the shared folder: its result."""
    kept = lambda: set(os.listdir(f"{work_dir(spark).removeprefix('file:')}/factloom"))
    cut(spark.range(1), "so that the folder is there")
    before = kept()
    one, two = (sorted(map(tuple, corpus_pipeline.run(spark, SF).collect()), key=repr) for _ in range(2))
    assert one == two
    assert [name.rsplit("-", 1)[0] for name in kept() - before] == ["pipeline-best_fit_packing"] * 2


def test_scratch_blocks(spark):
    """What is cut goes with its block, what is kept goes with the next one further out."""
    there = lambda df: os.path.exists(df._factloom_path.removeprefix("file:"))
    with scratch():
        with scratch():
            inner, result = cut(spark.range(3), "inner"), keep(spark.range(4), "result")
        assert not there(inner) and there(result) and result.count() == 4
    assert not there(result) and there(keep(spark.range(5), "alone"))
