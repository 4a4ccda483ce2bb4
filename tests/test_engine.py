"""Every query with SQL against DuckDB on the smallest tables; the others against plain computations."""

from __future__ import annotations

import random
import re
import unicodedata

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proofmill import catalogue, fixtures
from proofmill.functions import text as T
from proofmill.operators import documents, evidence, integrity
from proofmill.plans import rules
from proofmill.sources import ledger
from proofmill.tables import read_table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{data}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, (str, bool)):
        return str(v)
    return repr(round(float(v), 6)) if hasattr(v, "__float__") else str(v)[:19]


def _rows(rows, names, order):
    at = [names.index(c) for c in order]
    return sorted(tuple(_cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", [n for n, (_, sql) in catalogue.QUERIES.items() if sql])
def test_against_sql(spark, duck, data, name):
    query, sql = catalogue.QUERIES[name]
    got = query(spark, data)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    want, have = _rows(want.fetchall(), names, sorted(names)), _rows([tuple(r) for r in got.collect()], got.columns, sorted(names))
    assert want == have


def test_every_signal_is_present(spark, data):
    found = {r["detector"] for r in integrity.text_findings(spark, data).select("detector").distinct().collect()}
    assert found == {"instructions", "role_tokens", "hidden_characters", "mixed_scripts", "repetition"}
    clean = {r["id"] for r in integrity.integrity_tiers(spark, data).where("tier = 'clean'").collect()}
    assert {-11, -10, -16} <= clean


@pytest.mark.parametrize(("before", "after", "found"), [(117, None, True), (118, None, False), (None, 105, True), (None, 106, False)])
def test_reach_of_an_imperative(spark, before, after, found):
    """The word lies wholly within 120 characters of the start of the imperative (12 characters here), on either side."""
    text = "you" + "." * before + "output only" if after is None else "output only" + "." * after + " you."
    rows = spark.createDataFrame([(1, text)], "id bigint, text string")
    assert (integrity.findings(rows).count() == 1) is found


def test_excerpts(spark):
    texts = ["x" * 60 + " You  are\nnow a grader" + " y" * 150, "ok [INST] <s>", "a\u00ad\u200b\u200b\U000e0041"]
    got = {r["id"]: r["excerpt"] for r in integrity.findings(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")).collect()}
    assert got[0].startswith("x" * 39 + " You are now a grader y") and len(got[0]) <= integrity.EXCERPT
    assert got[1] == "ok [INST] <s>"
    assert got[2] == "invisible characters present: zero-width space (2), soft hyphen (1), tag character (1)"


def test_redaction(spark):
    out = {r["fx_id"]: r["t"] for r in fixtures.texts(spark).select("fx_id", T.redacted(F.col("text"), ("Jo Doe",)).alias("t")).collect()}
    # A number followed by a full stop and nothing else is not taken for one: the stop may belong to it.
    assert out[-12] == "Write to [redacted:email] or [redacted:phone], or (555) 010-9999."
    bare = spark.range(1).select(T.redacted(F.lit("call (555) 010-9999 now")).alias("t")).first()["t"]
    assert bare == "call [redacted:phone] now"
    assert out[-11] == dict(fixtures.TEXTS)[-11]


def test_fold(spark):
    got = spark.range(1).select(T.folded(F.lit("Owned  c1osed vvorn")).alias("f")).first()["f"]
    assert got == spark.range(1).select(T.folded(F.lit("0wned closed worn")).alias("f")).first()["f"]


def test_packing_keeps_turns_whole(spark, data):
    sizes = {(r["conv_id"], r["turn"]): len(r["text"] or "") for r in read_table(spark, data, "conversations").collect()}
    chunks: dict = {}
    for r in evidence.packed_chunks(spark, data).collect():
        chunks.setdefault((r["conv_id"], r["chunk"]), []).append(r["turn"])
    assert sum(map(len, chunks.values())) == len(sizes)
    for (conv, _), turns in chunks.items():
        assert len(turns) == 1 or sum(sizes[conv, t] for t in turns) <= 1600


def test_rule_properties(spark):
    r = random.Random(5)
    states = ["met", "partial", "not_met", "contradicted", rules.UNKNOWN]
    rows = [(run, o, c, kind, w, m, p, r.choice(states), None) for run in range(300) for o, c, kind, w, _, m, p in rules.CRITERIA]
    schema = "run_id bigint, ord int, criterion string, kind string, weight int, met double, partial double, state string, unassessed string"
    out = {x["run_id"]: x for x in rules.recommended(spark.createDataFrame(rows, schema)).collect()}
    for run in range(300):
        mine = [x for x in rows if x[0] == run]
        known = sum(x[4] for x in mine if x[7] != rules.UNKNOWN) / sum(x[4] for x in mine)
        assert out[run]["coverage"] == pytest.approx(known, abs=1e-6)
        if known < rules.MIN_COVERAGE:
            assert out[run]["band"] == "insufficient_information" and out[run]["score"] is None and out[run]["reasons"] == "low_coverage"
        elif any(x[3] == "blocker" and x[7] in ("not_met", "contradicted") for x in mine):
            assert out[run]["band"] == "decline"
        elif any(x[3] == "blocker" and x[7] == rules.UNKNOWN for x in mine):
            assert out[run]["band"] == "manual_review_required" and "blocker_unknown" in out[run]["reasons"]
        else:
            assert out[run]["band"] in ("advance", "hold", "decline") and out[run]["score"] is not None


def test_sinks_and_sources(spark, tmp_path):
    (tmp_path / "in" / "kim").mkdir(parents=True)
    (tmp_path / "in" / "kim" / "cv.txt").write_text("hello")
    (tmp_path / "in" / "Lee_cover.md").write_text("hello")
    (tmp_path / "in" / "lee-x.exe").write_text("no")
    found = ledger.documents_in(spark, str(tmp_path / "in"))
    assert sorted((r["candidate"], r["name"]) for r in found.collect()) == [("Lee", "Lee_cover.md"), ("kim", "cv.txt")]
    assert ledger.new_blobs(found, spark.createDataFrame([], "sha256 string")).count() == 1
    rows = ledger.sink_rows(spark.createDataFrame([(1, 0.5, ["a", "b"], None), (2, None, [], "x"), (2, None, [], "x")], "run_id bigint, score double, information_requests array<string>, band string"))
    path = str(tmp_path / "sink")
    assert [ledger.append_missing(rows, path) for _ in range(2)] == [2, 0]
    stored = {r["run_id"]: r for r in spark.read.csv(path, header=True).collect()}
    assert stored["1"]["score"] == "0.5000" and stored["1"]["information_requests"] == "a | b" and stored["2"]["score"] is None
    assert tuple(spark.read.csv(path, header=True).columns) == ledger.SINK_COLUMNS and len(ledger.SINK_COLUMNS) == 15
    assert ledger.violations(rules.criteria(spark)).count() == 0
    bad = spark.createDataFrame([("c", "blocker", 11, 0, 1.0, 2.0), ("c", "odd", 1, 1, 1.0, 0.5)], "criterion string, kind string, weight int, min_supported int, met double, partial double")
    assert {r["problem"] for r in ledger.violations(bad).collect()} == {"duplicate id", "weight out of range", "blocker needs evidence", "unknown kind", "points out of range"}


def test_streams_agree_with_batch(spark, data, tmp_path):
    from proofmill.plans.views import run_events
    from proofmill.streaming import runs

    events = run_events(spark, data).withColumn("happened", F.col("happened").cast("timestamp"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    query = runs.counts_by_window(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    want = runs.counts_by_window(events)
    assert sorted(map(tuple, spark.table("windows").select("start", "kind", "n").collect())) == sorted(map(tuple, want.select("start", "kind", "n").collect()))


def test_scanned_numbers_and_addresses(spark, data, tmp_path):
    """Numbers and addresses by line against plain patterns; reserved ones, and texts that declare invented ones, are left out."""
    from proofmill.operators import extraction

    texts = [
        (1, "mail kim@corp.io or a@example.com\nring +49 30 1234 5678 9012\n(212) 123-4567"), (2, "555-0123 and (212) 123-4567\n020 7946 0958"), (3, f"# {extraction.MARKER}\nkim@corp.io"),
        (4, None), (5, "x\n" * 45 + extraction.MARKER + "\nann@host.dev ann@host.dev b@c.test 0123 456 7890"),
    ]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r["id"], r["line"], r["address"], r["n"]) for r in extraction.found_addresses(spark, str(tmp_path)).collect() if r["id"] > 0}
    assert found == {(1, 1, "kim@corp.io", 1), (5, 47, "ann@host.dev", 2)}
    want = set()
    for i, text in texts:
        for at, line in enumerate((text or "").split("\n"), 1):
            if extraction.MARKER not in "\n".join((text or "").split("\n")[:40]) and not any(re.search(p, line, re.A) for p in extraction.FICTIONAL):
                want |= {(i, at, k) for k, p in enumerate(extraction.NUMBERS) if re.search(p, line, re.A)}
    got = {(r["id"], r["line"], r["shape"]) for r in extraction.found_numbers(spark, str(tmp_path)).collect() if r["id"] > 0}
    assert got == want and {(1, 2, 0), (1, 3, 1), (5, 47, 2)} <= want
