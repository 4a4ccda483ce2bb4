"""A training-data pipeline over ``documents``: five stages, each of one operator of ``proofmill.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.llm import scratch
from proofmill.llm.decontaminate import without_leaks
from proofmill.llm.jaccard import jaccard_components
from proofmill.llm.mixing import mix_sources
from proofmill.llm.quality import THRESHOLD, scorer
from proofmill.llm.secrets import redacted, scan
from proofmill.tables import read_table


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or with as many underscores as make it a column that ``docs`` lacks."""
    while name in docs.columns:
        name += "_"
    return name


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality vote accepts, with all their columns.

    Only texts are scored, whole: null texts as empty ones, repeated rows alike, so all or none of them stay. Ids and other
    columns may be null or have any name. Without a labelled row all documents stay; an empty table gives no rows.
    """
    score = scorer(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return docs.where(score(docs["text"]) >= THRESHOLD)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, with all its columns.

    Null, empty and blank texts are copies of nothing and stay, as do rows with a null id. Rows that share an id are one
    document: all of them stay or go. Of equal texts the smallest id stays; texts are compared whole, whatever their
    length. An empty table gives no rows.
    """
    groups = jaccard_components(docs)
    gone = scratch.materialize(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def keep_clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item, with all their columns.

    Null and empty texts leak nothing and stay; of the rows of one id, null among them, all go if one leaks. Texts are
    searched whole, repeated rows alike. Without an item all documents stay; an empty table gives no rows.
    """
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced and ``n_chars`` of the new text; texts without a secret stay as they are.

    Null texts stay null, and ``n_chars`` of a text without a secret is left alone, null or not. Texts are scanned whole and
    equal texts redacted alike, so repeated rows stay repeated. Columns may have any name; an empty table gives no rows.
    """
    found = scan(docs.select(F.struct("*").alias("row"), docs["text"].alias("text")), keep=("row",))
    some = F.size("spans") > 0
    text = redacted(F.coalesce("row.text", F.lit("")), F.col("spans"))
    cut = found.select("row", F.when(some, text).otherwise(F.col("row.text")).alias("cut"), some.alias("some"))
    new = {"text": F.col("cut"), "n_chars": F.when(F.col("some"), F.length("cut").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with the number of copies and the words taken.

    Each row is rounded for itself, so repeated rows and rows with a null id can get different copies. Null and empty texts
    have no words and are not taken; null sources are one source. The columns added are ``copies``, ``size`` and
    ``taken``, with underscores after a name that ``docs`` has. An empty table gives no rows.
    """
    row = free_name(docs, "row_id")
    rows = scratch.materialize(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    taken = mix_sources(rows, id_col=row, draw_col="doc_id").where(F.col("copies") > 0)
    taken = taken.select(F.col(row).alias("of"), *(F.col(c).alias(free_name(docs, c)) for c in ("copies", "size", "taken")))
    return rows.join(taken, rows[row] == taken["of"]).drop(taken["of"]).drop(row)


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram jaccard join", keep_one_of_near_copies),
    ("benchmark decontamination", keep_clean_of_benchmark),
    ("secret scans", redact_secrets),
    ("mixing sources", mix),
]

#: A vote of nearest neighbours and seeded rounding are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written and reread as the next one's."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.materialize(stage(spark, docs, sf_dir), f"stage-{number}")
    return docs
