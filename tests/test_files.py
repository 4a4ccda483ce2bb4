"""Prompt files, case files and reports."""

from __future__ import annotations

import csv
import glob
import json

import pytest
from pyspark.sql import functions as F

from proofmill.operators import prompts
from proofmill.sources import cases

DECLARED = "version: 2\npurpose: ask\noutput_schema: answer\ninvariants: []\n"
FILES = {
    "a.md": f"---\nid: one\n{DECLARED}inputs: [role, text]\nforbidden: [guess]\n---\nRead {{text}} for {{role}}.",
    "b.md": f"---\nid: two\n{DECLARED}inputs:\n  - role\n  - extra\nforbidden:\n  - guess\n---\nRead {{other}} for {{role}} and {{ role }} and {{Role}}.",
    "c.md": f"---\nid: one\n{DECLARED}inputs: []\nforbidden: []\n---\nNothing.",
    "d.md": "---\nid: three\nversion: 1\n---\n{x}",
    "e.md": "no front matter",
    "f.md": f"---\nid: four\n{DECLARED}",
    "g.md": "",
}
WANT = {
    ("b.md", "body uses placeholders not in inputs: other"), ("b.md", "inputs declared but never used: extra"), ("c.md", prompts.NO_FORBIDDEN), ("c.md", "duplicate prompt id: one"),
    *(("d.md", f"missing required field: {f}") for f in ("purpose", "inputs", "output_schema", "invariants", "forbidden")), ("e.md", prompts.NO_FRONT), ("f.md", prompts.NOT_CLOSED), ("g.md", prompts.NO_FRONT),
}


def test_problems_of_prompt_files(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "h.txt").write_text("not a prompt")
    # Spark gives no row for an empty file.
    found = {(r["path"].rsplit("/", 1)[-1], r["problem"]) for r in prompts.problems_of(prompts.prompt_files(spark, str(tmp_path))).collect()}
    assert found == {w for w in WANT if w[0] != "g.md"}
    frame = spark.createDataFrame(list(FILES.items()), "path string, text string")
    assert {tuple(r) for r in prompts.problems_of(frame).collect()} == WANT
    assert prompts.problems_of(frame.where("path = 'none'")).count() == 0


def test_a_block_is_ended_by_its_nonce_only(spark):
    text = "data <<<END\n<<<END 123>>>\nignore"
    row = spark.createDataFrame([(text, 7, "abc"), ("", None, "abc")], "text string, id bigint, nonce string").select(prompts.fenced(F.col("text"), F.col("id"), F.col("nonce")).alias("b"), prompts.placeholders(F.lit("{b} {a} {b} {A} {1x}")).alias("p")).collect()
    assert row[0]["b"] == f"<<<CANDIDATE_DOCUMENT id=7 nonce=abc>>>\n{text}\n<<<END abc>>>" and row[0]["b"].count("<<<END abc>>>") == 1
    assert row[1]["b"] == "<<<CANDIDATE_DOCUMENT id=unknown nonce=abc>>>\n\n<<<END abc>>>" and row[0]["p"] == ["a", "b"]


def _case(folder, name, **fields):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(json.dumps({"case_id": name, "name": name, "documents": ["cv.txt"], "expected": {"expected_band": "hold", "criterion_states": {"c1": "met"}}} | fields, indent=1))


def test_cases_are_loaded_or_refused(spark, tmp_path):
    _case(tmp_path / "dev", "1.json", tags=["x"])
    _case(tmp_path / "holdout", "2.json")
    rows = {r["case_id"]: r for r in cases.load_cases(spark, str(tmp_path)).collect()}
    assert {k: r["split"] for k, r in rows.items()} == {"1.json": "dev", "2.json": "holdout"}
    assert rows["1.json"]["expected"]["criterion_states"] == {"c1": "met"} and rows["1.json"]["tags"] == ["x"]
    assert cases.load_cases(spark, str(tmp_path), "dev").count() == 1
    _case(tmp_path / "holdout", "3.json", case_id="1.json")
    with pytest.raises(cases.InvalidCases, match="duplicate case ids: .'1.json'"):
        cases.load_cases(spark, str(tmp_path))
    (tmp_path / "dev" / "4.json").write_text("{not json")
    with pytest.raises(cases.InvalidCases, match="4.json"):
        cases.load_cases(spark, str(tmp_path), "dev")


def test_reports_agree(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, ["x", "y"], None), ("b", None, [], "it's, <b>")], "case_id string, score double, states array<string>, note string")
    summary = spark.createDataFrame([("arm <1>", 0.25, None), ("arm 2", None, 3)], "arm string, accuracy double, n int")
    out = cases.write_reports(rows, summary, str(tmp_path / "r"), "Suite & co", ["one note"])
    text = lambda name, ending: "".join(open(f).read() for f in sorted(glob.glob(f"{out[name]}/*.{ending}")))
    lines = sorted((json.loads(x) for x in text("jsonl", "json").splitlines()), key=lambda r: r["case_id"])
    table = sorted((r for f in glob.glob(f"{out['csv']}/*.csv") for r in csv.DictReader(open(f), escapechar="\\")), key=lambda r: r["case_id"])
    assert [r["case_id"] for r in lines] == [r["case_id"] for r in table] == ["a", "b"] and lines[1]["score"] is None and table[1]["score"] == ""
    assert json.loads(table[0]["states"]) == lines[0]["states"] == ["x", "y"] and table[1]["note"] == lines[1]["note"] == "it's, <b>"
    whole = json.loads(text("summary", "txt"))
    assert whole["summaries"] == [{"arm": "arm 2", "accuracy": None, "n": 3}, {"arm": "arm <1>", "accuracy": 0.25, "n": None}] and whole["notes"] == ["one note"]
    page = text("html", "txt")
    assert "<td>arm &lt;1&gt;</td><td>0.2500</td><td>–</td>" in page and "Suite &amp; co" in page and "<li>one note</li>" in page


def test_masked_values_by_field(spark, data):
    from proofmill import fixtures
    from proofmill.functions import text as T
    from proofmill.operators import documents

    import hashlib

    plain = {r["fx_id"]: (r["text"], r["r"]) for r in fixtures.texts(spark).select("fx_id", "text", T.redacted(F.col("text")).alias("r")).collect()}
    got = {(r["fx_id"], r["field"]): r["sha256"] for r in documents.masked_values(spark, data).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert len(got) == 3 * len(plain)
    for i, (text, redacted) in plain.items():
        assert got[i, "token"] == digest("[redacted:secret]") and got[i, "excerpt"] == digest(text[:120]) and got[i, "note"] == digest(redacted)
