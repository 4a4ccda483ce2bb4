"""The pipeline's stages on the smallest tables, each held against its operator or a plain rule."""

from __future__ import annotations

import re

from pyspark.sql import functions as F


def test_stages_keep_columns_and_take_effect(spark, data):
    import corpus_pipeline
    from proofmill.llm import decontaminate, jaccard, scratch
    from proofmill.tables import read_table

    docs = read_table(spark, data, "documents")
    names, inputs = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.materialize(stage(spark, inputs, data), "stage")
        if name != "mixing sources":
            assert out.columns == names
        ids = {r["doc_id"] for r in inputs.select("doc_id").collect()}
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= ids
        if name == "quality classifier":
            noisy = inputs.where(F.regexp_count("text", F.lit(r"[$&%#*]{3}|!!")) > 20)
            assert noisy.count() and not kept & {r["doc_id"] for r in noisy.collect()}
            assert len(kept) > 0.7 * len(ids)
        if name == "n-gram jaccard join":
            assert out.count() == jaccard.jaccard_components(inputs).select("component_id").distinct().count()
        if name == "benchmark decontamination":
            assert decontaminate.find_leaks(out, read_table(spark, data, "benchmark")).count() == 0
        if name == "secret scans":
            assert kept == ids
            assert not any(re.search("AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"] or "") for r in out.collect())
            assert out.where(F.length("text") != F.col("n_chars")).count() == inputs.where(F.length("text") != F.col("n_chars")).count()
        inputs = out
    assert inputs.where("taken > 3 * size or copies < 1").count() == 0


def test_run_matches_stages(spark, data):
    import corpus_pipeline
    from proofmill.llm import scratch
    from proofmill.tables import read_table

    docs = read_table(spark, data, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.materialize(stage(spark, docs, data), "stage")
    got = corpus_pipeline.run(spark, data)
    assert got.columns == docs.columns and got.count() == docs.count() > 0
    key = ["doc_id", "text", "n_chars"]
    assert sorted(map(repr, got.select(*key).collect())) == sorted(map(repr, docs.select(*key).collect()))


CLASHING = ("gone", "leaking", "base", "spans", "tokens", "row", "row_id", "copies", "size", "taken", "of", "rep", "cut", "some")


def _folder(spark, tmp_path, docs):
    import random

    r = random.Random(5)
    words = lambda n, k: " ".join(random.Random(k).choice("alpha beta gamma delta omega sigma kappa lambda".split()) + str(random.Random(k + i).randint(0, 99)) for i in range(n))
    labelled = [(1000 + i, words(60, i) + ".", "en", "s", 10) for i in range(60)] + [(2000 + i, "$$ !! zz zz zz " * r.randint(9, 20), "en", "s", 10) for i in range(40)]
    frame = spark.createDataFrame(labelled + docs(words), "doc_id bigint, text string, lang string, source string, n_chars bigint")
    frame.withColumns({c: F.lit("clash") for c in CLASHING}).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 2000), 0) for i, *_ in labelled], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, words(40, 900)), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), words


def test_stages_on_edges(spark, tmp_path):
    """Nulls in any column, empty and very long texts, ties, repeated rows and clashing names: each stage's defined outcome."""
    import corpus_pipeline as p
    from proofmill.llm import scratch
    from proofmill.tables import read_table

    def docs(words):
        long = words(40_000, 300)
        return [
            (1, None, None, None, None), (2, "", "en", "t", 0), (None, words(50, 400), "en", "t", 9), (None, words(50, 400), "en", "t", 9), (3, words(50, 400), "en", None, 9),
            (4, long, "en", "t", None), (5, words(50, 500) + " password=abcdef123", "en", "t", 5), (5, words(50, 500) + " password=abcdef123", "en", "t", 5),
            (6, words(50, 600), "en", "t", 1), (7, words(50, 600), "en", "t", 1), (8, words(30, 700) + " " + words(40, 900), "en", "t", 1),
        ]

    folder, words = _folder(spark, tmp_path, docs)
    rows, names = read_table(spark, folder, "documents"), read_table(spark, folder, "documents").columns
    ids = lambda frame: sorted((r["doc_id"] for r in frame.select("doc_id").collect() if r["doc_id"] is None or r["doc_id"] < 1000), key=str)
    kept = scratch.materialize(p.keep_quality(spark, rows, folder), "a")
    assert kept.columns == names and set(ids(kept)) >= {3, 4, 5, 6, 7, 8, None} and not [r for r in kept.select("doc_id").collect() if (r["doc_id"] or 0) >= 2000]
    one = scratch.materialize(p.keep_one_of_near_copies(spark, rows, folder), "b")
    assert one.columns == names and ids(one) == sorted([1, 2, None, None, 3, 4, 5, 5, 6, 8], key=str)
    clean = scratch.materialize(p.keep_clean_of_benchmark(spark, one, folder), "c")
    assert clean.columns == names and ids(clean) == sorted([1, 2, None, None, 3, 4, 5, 5, 6], key=str)
    cut = scratch.materialize(p.redact_secrets(spark, clean, folder), "d")
    of = {r["doc_id"]: r for r in cut.collect()}
    assert cut.columns == names and ids(cut) == ids(clean) and of[5]["text"].endswith("[secret]") and of[5]["n_chars"] == len(of[5]["text"])
    assert of[1]["text"] is None and of[1]["n_chars"] is None and of[2]["text"] == "" and of[4]["n_chars"] is None and of[4]["text"] == words(40_000, 300)
    mixed = p.mix(spark, cut, folder)
    assert mixed.columns == [*names, "copies_", "size_", "taken_"]
    got = mixed.select("doc_id", "text", "copies_", "size_", "taken_").collect()
    assert {r["doc_id"] for r in got} <= {r["doc_id"] for r in cut.select("doc_id").collect()} and not {1, 2} & {r["doc_id"] for r in got}
    assert all(1 <= r["copies_"] <= 3 and r["size_"] == len(r["text"].split()) and r["taken_"] == r["copies_"] * r["size_"] for r in got)
    for _, stage in p.STAGES:
        assert stage(spark, rows.where("false"), folder).count() == 0
