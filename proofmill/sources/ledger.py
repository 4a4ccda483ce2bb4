"""Sources and sinks: folders of documents, append-only tables, CSV and JSON lines, all through Spark's readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: File endings that a folder of documents may hold.
ALLOWED = ("pdf", "docx", "txt", "md")
SINK_COLUMNS = (
    "delivered_at", "run_id", "candidate_id", "role_id", "band", "score", "coverage", "reviewer_id", "reviewer_action", "decided_at",
    "override_count", "integrity_tier", "derivation", "criterion_states", "information_requests",
)


def candidate_of(name: Column, separators: tuple[str, ...] = ("_", "-", " ")) -> Column:
    """A3: the stem of a file's name in lower case before its first "_"; without one before "-"; without one before a blank. An empty part leaves the stem."""
    stem = F.lower(F.trim(F.regexp_replace(name, r"\.[^.]*$", "")))
    part = stem
    for separator in reversed(separators):
        part = F.when(F.contains(stem, F.lit(separator)), F.split_part(stem, F.lit(separator), F.lit(1))).otherwise(part)
    return F.coalesce(F.nullif(part, F.lit("")), F.nullif(stem, F.lit("")), F.lit("candidate"))


def prefix_of(name: Column) -> Column:
    """A1: for files beside the subfolders, the stem before its first "_" or "-", as it is written; an empty part leaves the stem."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.coalesce(F.nullif(F.regexp_extract(stem, "^[^_-]*", 0), F.lit("")), stem)


def documents_in(spark: SparkSession, folder: str) -> DataFrame:
    """A1, A2: (candidate, name, sha256, n_bytes, content) of allowed files below ``folder``.

    A subfolder is a candidate with all that is below it; loose files are grouped by name. Spark lists the folder, so no path leaves it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts, top = F.split(F.regexp_replace("path", r"/+$", ""), "/"), F.lit(folder.rstrip("/").split("/")[-1])
    name, parent = F.element_at(parts, -1), F.element_at(parts, -2)
    # The candidate's folder is the part after the last that is called like the top folder's place in the path.
    depth = F.lit(len([p for p in folder.split("://")[-1].split("/") if p]))
    places = F.filter(F.split(F.regexp_replace("path", "^[a-z0-9]+:/*", ""), "/"), lambda p: p != "")
    below = F.get(places, depth)
    loose = (parent == top) & (F.size(places) == depth + 1)
    named = files.select(F.when(loose, prefix_of(name)).otherwise(below).alias("candidate"), name.alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("n_bytes"), "content")
    return named.where(F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*ALLOWED))


def new_blobs(found: DataFrame, stored: DataFrame) -> DataFrame:
    """A4: contents that the store lacks, each once, with the prefix by which the store is partitioned."""
    return found.join(stored.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))


def sink_rows(runs: DataFrame) -> DataFrame:
    """A5: the fixed columns of the CSV sink: lists joined, numbers to four places, nothing (not 0) for a missing one."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kinds = dict(runs.dtypes)
    out = []
    for name in SINK_COLUMNS:
        if name not in kinds:
            value = F.lit("")
        elif kinds[name].startswith("array"):
            value = F.coalesce(F.array_join(name, " | "), F.lit(""))
        elif kinds[name] == "double":
            value = F.when(F.col(name).isNotNull(), F.format_string("%.4f", F.col(name))).otherwise("")
        else:
            value = text(name)
        out.append(value.alias(name))
    return runs.select(*out)


def append_missing(rows: DataFrame, path: str, key: str = "run_id") -> int:
    """Append the rows whose key ``path`` lacks, each once; returns how many. A second call appends none."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates([key])
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        fresh = fresh.join(spark.read.schema(rows.schema).csv(path, header=True).select(key), key, "left_anti")
    fresh = fresh.select(*rows.columns).persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").csv(path, header=True)
    fresh.unpersist()
    return n


def write_log(events: DataFrame, path: str, at: str = "happened") -> None:
    """JSON lines by day; security events go to a folder of their own too."""
    lines = events.select(F.date_format(at, "yyyy-MM-dd").alias("day"), F.to_json(F.struct(*events.columns)).alias("value"), "kind")
    lines.select("day", "value").write.mode("append").partitionBy("day").text(f"{path}/all")
    lines.where(F.col("kind").startswith("security")).select("day", "value").write.mode("append").partitionBy("day").text(f"{path}/security")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Of append-only rows the last of each key."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_nth", nth).where(F.col("_nth") == 1).drop("_nth")


def human_bands(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a reviewers' CSV with a case and a known band; unparsable minutes are null."""
    rows = spark.read.schema("case_id string, band string, minutes double, reviewer_id string").csv(path, header=True)
    return rows.where((F.trim("case_id") != "") & F.col("band").isin("advance", "hold", "decline"))


def violations(criteria: DataFrame) -> DataFrame:
    """H26, A12, section 1.4: (criterion, problem) for every rule of a rubric that a row breaks; no row means it is sound."""
    c = F.col
    criteria = criteria.withColumn("_many", F.count("*").over(Window.partitionBy("criterion")))
    twice = c("_many") > 1
    problems = F.array_compact(F.array(
        F.when(twice, F.lit("duplicate id")),
        F.when(~c("weight").between(1, 10), F.lit("weight out of range")),
        F.when((c("kind") == "blocker") & (c("min_supported") < 1), F.lit("blocker needs evidence")),
        F.when(~c("kind").isin("standard", "high_stakes", "blocker"), F.lit("unknown kind")),
        F.when(~c("met").between(0, 1) | ~c("partial").between(0, 1) | (c("partial") > c("met")), F.lit("points out of range")),
    ))
    return criteria.select("criterion", F.explode(problems).alias("problem"))


def retry_schedule(spark: SparkSession, attempts: int = 3, seed: int = 0, jitter: float = 0.3) -> DataFrame:
    """(attempt, delay): seconds after each failed attempt but the last, doubling from half a second; a part drawn by ``seed`` is added or taken off, and the cap of eight comes last."""
    drawn = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1_000_000)) / 1_000_000
    raw = 0.5 * F.pow(F.lit(2.0), F.col("id") - 1) * (1 - jitter + 2 * jitter * drawn)
    return spark.range(1, attempts).select(F.col("id").alias("attempt"), F.least(F.lit(8.0), raw).alias("delay"))


def failure_class(status: Column) -> Column:
    """What an HTTP status means for a retry; what is neither known nor a success is permanent, no status is a service that was not reached."""
    named = F.when(status.isNull(), "transient").when(status == 429, "rate_limited").when(status.isin(401, 403), "auth").when(status == 404, "config")
    return named.when(status.between(500, 599), "transient").when(status < 400, "ok").otherwise("permanent")
