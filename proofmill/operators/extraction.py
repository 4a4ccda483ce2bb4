"""Extraction: paragraphs, pages and readings, and scans line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.functions import text as T
from proofmill.operators import integrity
from proofmill.plans import rules
from proofmill.tables import read_table

THIN_CHARS, OCR_PAGES, RETRY_BELOW = 100, 20, 0.6
PROFILE = "profile-1"
#: Domains that standards reserve for examples, and the header that declares invented identifiers.
RESERVED_DOMAINS = ("example.com", "example.net", "example.org")
RESERVED_ENDINGS = (".example.com", ".example.net", ".example.org", ".example", ".invalid", ".test", ".localhost")
MARKER, MARKER_LINES = "check_pii: invented-identifiers", 40
#: Shapes of addresses and numbers in source files, and numbers that are set aside for fiction.
ADDRESS = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
NUMBERS = (
    r"(?<![\w\-])\+\d{1,3}[\s.\-]?\(?\d{1,4}\)?(?:[\s.\-]?\d{2,4}){2,4}(?![\w\-])",
    r"(?<![\w\-])\(\d{3}\)\s?\d{3}[\s.\-]?\d{4}(?![\w\-])",
    r"(?<![\w\-])0\d{2,4}[\s.\-]\d{3,4}[\s.\-]?\d{3,4}(?![\w\-])",
)
FICTIONAL = (
    r"(?:\+?44[\s.\-]?)?\(?0?20\)?[\s.\-]?7946[\s.\-]?0\d{3}",
    r"(?:\+?44[\s.\-]?)?\(?0?7700\)?[\s.\-]?900\d{3}",
    r"555[\s.\-]?01\d{2}",
    r"(?:\+?1[\s.\-]?)?\(?555\)?[\s.\-]?\d{3}[\s.\-]?\d{4}",
)


# -- paragraphs


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text's paragraphs, which blank lines part: stripped, empty ones left out, joined by line breaks."""
    parts = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n[ \t]*\n", -1), lambda p: F.regexp_replace(p, r"^[ \t\n]+|[ \t\n]+$", "")), lambda p: p != "")
    return read_table(spark, sf_dir, "documents").select("doc_id", F.size(parts).cast("bigint").alias("n_paragraphs"), F.sha2(F.array_join(parts, "\n"), 256).alias("sha256"))


# -- pages and readings


def ocr_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which pages go to OCR, and which of two readings is kept.

    Turns stand for pages. A page with fewer than 100 stripped characters goes to OCR, the first 20 of a document at most.
    A first reading that is surer than 0.6 stands; otherwise the page is read again, and the surer reading is kept.
    """
    pages = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(F.trim(F.coalesce("text", F.lit("")))) < THIN_CHARS).alias("thin"))
    nth = F.count_if("thin").over(Window.partitionBy("conv_id").orderBy("turn"))
    decided = pages.withColumn("ocr", F.col("thin") & (nth <= OCR_PAGES))
    sure = lambda k: F.pmod(F.col("conv_id") * 31 + F.col("turn") * 17 + k, F.lit(100)) / 100
    kept = F.when(sure(0) >= RETRY_BELOW, "first").when(sure(43) > sure(0), "second").otherwise("first")
    return decided.select("conv_id", "turn", "ocr", F.when(F.col("ocr"), kept).alias("kept"), F.when(F.col("ocr"), F.when(kept == "second", sure(43)).otherwise(sure(0))).alias("confidence"))


def extraction_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are not yet extracted under the profile, each once, with the document that asks first.

    The store holds what every third document had, under this profile or, for every sixth, another one.
    """
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    stored = docs.where(F.col("doc_id") % 3 == 0).select("sha256", F.when(F.col("doc_id") % 6 == 0, "profile-0").otherwise(PROFILE).alias("profile"))
    known = stored.where(F.col("profile") == PROFILE).select("sha256").distinct()
    return docs.join(known, "sha256", "left_anti").groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_documents"))


# -- scans


def scanned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, line, text) of the texts that do not declare invented identifiers in their first 40 lines."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    declared = F.contains(F.array_join(F.slice(lines, 1, MARKER_LINES), "\n"), F.lit(MARKER))
    return integrity.sources(spark, sf_dir).where(~declared).select("id", F.posexplode(lines).alias("at", "text")).select("id", (F.col("at") + 1).cast("bigint").alias("line"), "text")


def found_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """addresses by line whose domain no standard reserves."""
    found = scanned_lines(spark, sf_dir).where(F.contains("text", F.lit("@"))).select("id", "line", F.explode(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(0))).alias("address"))
    domain = F.rtrim(F.lower(F.element_at(F.split("address", "@"), -1)), F.lit("."))
    reserved = domain.isin(*RESERVED_DOMAINS)
    for ending in RESERVED_ENDINGS:
        reserved = reserved | F.endswith(domain, F.lit(ending))
    return found.where(~reserved).groupBy("id", "line", "address").agg(F.count("*").alias("n"))


def found_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lines with a phone number, by the shapes that they have; a line with a number set aside for fiction is left out."""
    fiction = F.regexp_like("text", F.lit("|".join(FICTIONAL)))
    shapes = F.array_compact(F.array(*(F.when(F.regexp_like("text", F.lit(p)), F.lit(k)) for k, p in enumerate(NUMBERS))))
    return scanned_lines(spark, sf_dir).where(F.regexp_like("text", F.lit(r"\d")) & ~fiction).select("id", "line", F.explode(shapes).alias("shape"))


#: What is asked about a point of which nothing is said, and about one of which little is.
ASK_ABSENT = "Your application does not mention {label}. Could you tell us about your experience with this?"
ASK_MORE = "Your application touches on {label} but does not say much. Could you give us more detail?"


def composed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """questions for a run's open points: what was written for an open point and names nothing protected, else the template's.

    Items for points that are settled, and items on protected attributes, are dropped; a point left without one gets the template.
    """
    states = rules.resolved(rules.evidence_counts(spark, sf_dir), rules.criteria(spark))
    gaps = states.where(F.col("state").isin(rules.UNKNOWN, "partial", "contradicted")).select("run_id", "ord", "criterion", "state")
    written = F.when(F.col("ord") % 4 == 0, "Are you married?").otherwise(F.concat(F.lit("Could you say more about point "), F.col("ord").cast("string"), F.lit("?")))
    items = states.where((F.col("run_id") + F.col("ord")) % 3 == 0).select("run_id", "ord", written.alias("question"))
    fit = items.where(F.size(T.protected_terms(F.col("question"))) == 0).join(gaps.select("run_id", "ord"), ["run_id", "ord"], "left_semi")
    filled_in = lambda template: F.replace(F.lit(template), F.lit("{label}"), F.lower("criterion"))
    absent, little = filled_in(ASK_ABSENT), filled_in(ASK_MORE)
    filled = gaps.join(fit.select("run_id", "ord"), ["run_id", "ord"], "left_anti").select("run_id", "ord", F.when(F.col("state") == rules.UNKNOWN, absent).otherwise(little).alias("question"), F.lit("template").alias("made_by"))
    return fit.withColumn("made_by", F.lit("model")).unionByName(filled).groupBy("made_by", "question").agg(F.count("*").alias("n"))


# -- verdicts on findings


def raised_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severities of the findings of suspect texts after a classifier's verdict, which can only raise them; other texts are not asked about."""
    texts = integrity.sources(spark, sf_dir)
    found = integrity.findings(texts)
    suspect = integrity.tiers(found, texts).where(F.col("tier") == "suspect").select("id")
    verdict = F.get(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.pmod("id", F.lit(3)).cast("int"))
    rank = integrity._rank
    asked = found.join(suspect, "id", "left_semi").withColumn("verdict", verdict)
    raised = F.when(rank(F.col("verdict")) > rank(F.col("severity")), F.col("verdict")).otherwise(F.col("severity"))
    return asked.select("id", "detector", "severity", raised.alias("raised"))


#: Findings that are security events.
SECURITY = ("instructions", "role_tokens")


def security_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line for each finding of instructions or role marks; it names the text and the kind, never what was found."""
    found = integrity.text_findings(spark, sf_dir).where(F.col("detector").isin(*SECURITY))
    line = F.concat_ws(" ", F.lit("security"), F.col("detector"), F.col("severity"), F.concat(F.lit("text="), F.col("id").cast("string")))
    return found.select("id", "detector", line.alias("line"))


STEPS_SCHEMA = "rule string, template string, description string"
STEPS = [
    ("coverage", "Covered {coverage} of the weight.", "coverage"), ("score", "Scored {score} on {scale}.", "the score was computed"), ("band", None, "the band follows from the score"),
]


def explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each run's outcome is told, step by step: the template with its values, or the step's own words if a value is missing."""
    steps = fixtures.frame(spark, STEPS_SCHEMA, STEPS)
    told = rules.recommendations(spark, sf_dir).crossJoin(F.broadcast(steps))
    value = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c)))
    text = F.replace(F.col("template"), F.lit("{coverage}"), value("coverage"))
    text = F.when(F.contains(text, F.lit("{score}")), F.replace(text, F.lit("{score}"), value("score"))).otherwise(text)
    missing = text.isNull() | F.regexp_like(text, F.lit(r"\{\w+\}"))
    return told.select("rule", F.when(missing, F.col("description")).otherwise(F.trim(text)).alias("text")).groupBy("rule", "text").agg(F.count("*").alias("n"))


_LINES = f"""l AS (SELECT id, unnest(range(1, len(p) + 1)) AS line, unnest(p) AS text FROM (SELECT id, string_split(coalesce(text, ''), chr(10)) AS p FROM src WHERE NOT contains(array_to_string(string_split(coalesce(text, ''), chr(10))[1:{MARKER_LINES}], chr(10)), '{MARKER}')))"""
_SURE = lambda k: f"((conv_id * 31 + turn * 17 + {k}) % 100 / 100)"
_COUNT = lambda mark: f"(length(content) - length(replace(content, '{mark}', ''))) // {len(mark)}"

QUERIES = {
    "paragraphs": (paragraphs, r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\n[ \t]*\n'), lambda p: regexp_replace(p, '^[ \t\n]+|[ \t\n]+$', '', 'g')), lambda p: p <> '') AS p FROM documents)
        SELECT doc_id, len(p)::BIGINT AS n_paragraphs, sha256(coalesce(array_to_string(p, chr(10)), '')) AS sha256 FROM p"""),
    "ocr_decisions": (ocr_decisions, f"""WITH t AS (SELECT conv_id, turn, length(trim(coalesce(text, ''), ' ')) < {THIN_CHARS} AS thin FROM conversations), d AS (SELECT conv_id, turn, thin AND count(*) FILTER (thin) OVER (PARTITION BY conv_id ORDER BY turn) <= {OCR_PAGES} AS ocr FROM t)
        SELECT conv_id, turn, ocr, CASE WHEN ocr THEN CASE WHEN {_SURE(0)} >= {RETRY_BELOW} OR {_SURE(43)} <= {_SURE(0)} THEN 'first' ELSE 'second' END END AS kept,
            CASE WHEN ocr THEN CASE WHEN {_SURE(0)} >= {RETRY_BELOW} THEN {_SURE(0)} ELSE greatest({_SURE(0)}, {_SURE(43)}) END END AS confidence FROM d"""),
    "extraction_misses": (extraction_misses, f"""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents), k AS (SELECT DISTINCT sha256 FROM d WHERE doc_id % 3 = 0 AND doc_id % 6 <> 0)
        SELECT sha256, min(doc_id) AS first_id, count(*) AS n_documents FROM d ANTI JOIN k USING (sha256) GROUP BY sha256"""),
    "found_addresses": (found_addresses, f"""WITH {integrity.SOURCES}, {_LINES}, a AS (SELECT id, line, unnest(regexp_extract_all(text, '{ADDRESS}')) AS address FROM l), d AS (SELECT *, rtrim(lower(string_split(address, '@')[-1]), '.') AS domain FROM a)
        SELECT id, line, address, count(*) AS n FROM d WHERE domain NOT IN {RESERVED_DOMAINS} AND NOT ({" OR ".join(f"ends_with(domain, '{e}')" for e in RESERVED_ENDINGS)}) GROUP BY ALL"""),
    "found_numbers": (found_numbers, None),
    "composed_questions": (composed_questions, f"""WITH {rules._COUNTS}, g AS (SELECT run_id, ord, criterion, state FROM s WHERE state IN ('{rules.UNKNOWN}', 'partial', 'contradicted')),
        q AS (SELECT CASE WHEN (run_id + ord) % 3 = 0 AND ord % 4 <> 0 THEN 'model' ELSE 'template' END AS made_by, CASE WHEN (run_id + ord) % 3 = 0 AND ord % 4 <> 0 THEN 'Could you say more about point ' || ord || '?'
            WHEN state = '{rules.UNKNOWN}' THEN replace('{ASK_ABSENT}', '{{label}}', lower(criterion)) ELSE replace('{ASK_MORE}', '{{label}}', lower(criterion)) END AS question FROM g)
        SELECT made_by, question, count(*) AS n FROM q GROUP BY ALL"""),
    "raised_findings": (raised_findings, f"""WITH f AS ({integrity.QUERIES['text_findings'][1]}), t AS ({integrity.QUERIES['integrity_tiers'][1]}), r(severity, rank) AS (VALUES ('low', 1), ('medium', 2), ('high', 3))
        SELECT id, detector, f.severity, CASE WHEN (id % 3 + 3) % 3 + 1 > r.rank THEN ['low', 'medium', 'high'][(id % 3 + 3) % 3 + 1] ELSE f.severity END AS raised FROM f JOIN t USING (id) JOIN r USING (severity) WHERE tier = 'suspect'"""),
    "security_log": (security_log, f"SELECT id, detector, concat_ws(' ', 'security', detector, severity, 'text=' || id) AS line FROM ({integrity.QUERIES['text_findings'][1]}) WHERE detector IN {SECURITY}"),
    "explanations": (explanations, f"""WITH {rules._COUNTS}, {rules._recommend('s', 'r')}, {fixtures.sql("st", STEPS_SCHEMA, STEPS)}
        SELECT rule, CASE WHEN rule = 'coverage' THEN 'Covered ' || format('{{:.4f}}', coverage) || ' of the weight.' ELSE description END AS text, count(*) AS n FROM r, st GROUP BY ALL"""),
}
