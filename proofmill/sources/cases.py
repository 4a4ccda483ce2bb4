"""Evaluation cases from files, and the reports of a suite: one set of rows in every format."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLITS = ("dev", "holdout")
CASE = (
    "case_id string, name string, description string, role_id string, documents array<string>, tags array<string>, arms array<string>, "
    "expected struct<expected_band: string, criterion_states: map<string,string>, must_be_insufficient: array<string>, must_flag_integrity: boolean, forbidden_claims: array<string>, notes string>"
)


class InvalidCases(ValueError):
    """Files that are no cases, or ids that stand twice: either would make the benchmark smaller without a word."""


def load_cases(spark: SparkSession, root: str, split: str | None = None) -> DataFrame:
    """A10: the cases of one split or of all, a JSON file each, with their split; files that do not parse and ids that stand twice are refused.

    Only what is wrong reaches the driver, twenty names at most.
    """
    frames = [
        spark.read.schema(f"{CASE}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", "true").json(f"{root}/{name}/*.json").select("*", F.lit(name).alias("split"), F.col("_metadata.file_name").alias("file"))
        for name in ([split] if split else SPLITS)
    ]
    cases = frames[0]
    for more in frames[1:]:
        cases = cases.unionAll(more)
    cases = cases.persist()
    bad = sorted(r["file"] for r in cases.where(F.col("_corrupt").isNotNull() | F.col("case_id").isNull()).select("file").limit(20).collect())
    twice = sorted(r["case_id"] for r in cases.groupBy("case_id").count().where("count > 1 and case_id is not null").limit(20).collect())
    cases.unpersist()
    if bad:
        raise InvalidCases(f"not a case: {bad}")
    if twice:
        raise InvalidCases(f"duplicate case ids: {twice}")
    return cases.drop("_corrupt", "file")


def page(title: str, summary: list[dict], notes: list[str]) -> str:
    """A report for a person: the numbers of each arm in a table, escaped; what was not measured is a dash, never 0."""
    show = lambda v: "–" if v is None else html.escape(f"{v:.4f}" if isinstance(v, float) else str(v))
    columns = list(summary[0]) if summary else []
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    body = "".join("<tr>" + "".join(f"<td>{show(row[c])}</td>" for c in columns) + "</tr>" for row in summary)
    listed = "".join(f"<li>{html.escape(n)}</li>" for n in notes)
    return f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>{body}</table><ul>{listed}</ul></html>'


def write_reports(rows: DataFrame, summary: DataFrame, path: str, title: str, notes: list[str] | None = None) -> dict[str, str]:
    """The rows as CSV and as JSON lines, the summary as JSON and HTML, all below ``path``; returns the folders by format.

    Rows are written by the tasks; the summary has a row for each arm and metric and is the only thing that the driver sees.
    """
    spark = rows.sparkSession
    out = {name: f"{path}/{name}" for name in ("csv", "jsonl", "summary", "html")}
    flat = rows.select(*(F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in rows.dtypes))
    flat.write.mode("overwrite").csv(out["csv"], header=True)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(out["jsonl"])
    numbers = [r.asDict(recursive=True) for r in summary.orderBy(*summary.columns).collect()]
    whole = json.dumps({"title": title, "summaries": numbers, "notes": notes or []}, default=str)
    for name, text in (("summary", whole), ("html", page(title, numbers, notes or []))):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(out[name])
    return out
