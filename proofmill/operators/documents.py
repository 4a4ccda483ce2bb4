"""Documents: identity, roles, rejection, normal forms, redaction, and how their text divides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.functions import text as T
from proofmill.operators.integrity import SOURCES, sources
from proofmill.tables import read_table, spread

#: What a run is configured by: hashes of rubric, prompts and model bindings, the policy, blind mode, calibration, and the pipeline's version.
CONFIG = ("rubric-1", "prompts-1", "bindings-1", "policy-1", "False", "True", "1.0.0")


def document_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct content by its SHA-256, with the first document and the number of copies."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    hashed = read_table(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).alias("bytes"))
    return hashed.groupBy("sha256").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies"), F.max("bytes").cast("bigint").alias("n_bytes"))


def content_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate the hash of the sorted hashes of its documents and the seven parts of the configuration, apart by a unit separator; a candidate has five documents."""
    hashed = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 5).alias("candidate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    parts = F.concat_ws("\x1f", F.array_join(F.array_sort(F.collect_list("sha")), "\x1f"), *map(F.lit, CONFIG))
    return hashed.groupBy("candidate").agg(F.sha2(parts, 256).alias("content_key"))


#: First bytes of programs and of zip archives, in hexadecimal; the part that makes an archive a Word file.
PROGRAMS = ("4D5A", "7F454C46", "CAFEBABE", "FEEDFACE", "2321")
ZIPS = ("504B0304", "504B0506", "504B0708")
PDF, WORD_PART = "255044462D", b"word/document.xml"
MIME = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain"}
#: Characters that no reader sees; spaces and line breaks among them are allowed. Unassigned code points count as seen.
UNSEEN, ALLOWED = r"[\p{Cc}\p{Cf}\p{Cs}\p{Co}\p{Zl}\p{Zp}\p{Zs}]", r"[ \r\n\t]"
PRINTABLE_SHARE, HEAD_BYTES, SAMPLE_BYTES = 0.9, 8192, 4096
MAX_BYTES, MAX_PAGES, MIN_CHARS = 26_214_400, 60, 200


def kind_of(content: Column) -> Column:
    """Pdf, docx or txt by the bytes, null for anything else, whatever the name says.

    An archive is a Word file if its first or last 8 KiB name the part; nothing is unpacked. A text's first 4 KiB are UTF-8
    and over 90 % printable. An empty file is of no kind.
    """
    head = F.hex(F.substring(content, 1, 8))
    starts = lambda marks: F.coalesce(*(F.when(head.startswith(m), True) for m in marks), F.lit(False))
    word = F.contains(F.substring(content, 1, HEAD_BYTES), F.lit(WORD_PART)) | F.contains(F.substring(content, -HEAD_BYTES, HEAD_BYTES), F.lit(WORD_PART))
    sample = F.substring(content, 1, SAMPLE_BYTES).cast("string")
    seen = F.length(sample) - F.regexp_count(sample, F.lit(UNSEEN)) + F.regexp_count(sample, F.lit(ALLOWED))
    text = F.when(F.is_valid_utf8(sample), seen > PRINTABLE_SHARE * F.length(sample))
    return F.when(F.length(content) == 0, None).when(starts(PROGRAMS), None).when(starts((PDF,)), "pdf").when(starts(ZIPS), F.when(word, "docx")).when(text, "txt")


def classified(files: DataFrame, max_bytes: int = MAX_BYTES, max_pages: int = MAX_PAGES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Rows (file_id, name, content) with kind, MIME type, role by name, and the first reason to refuse; null accepts.

    In this order: too large, no accepted kind, encrypted, corrupt, too many pages (which count as too large), too short.
    """
    name, content, kind = F.lower("name"), F.col("content"), F.col("kind")
    role = F.when(name.contains("cover") | name.contains("letter"), "cover_letter").when(name.contains("portfolio") | name.contains("work"), "portfolio")
    role = role.when(name.contains("cv") | name.contains("resume"), "cv").otherwise("other")
    # One character a byte, for counts and for blanks at the ends.
    latin = F.decode(content, "ISO-8859-1")
    count = lambda mark: (F.length(latin) - F.length(F.replace(latin, F.lit(mark), F.lit("")))) / len(mark)
    pages = F.greatest(count("/Type /Page") - count("/Type /Pages"), F.lit(1.0))
    tail = lambda n, mark: F.contains(F.substring(content, -n, n), F.lit(mark))
    reason = (
        F.when(F.length(content) > max_bytes, "oversized")
        .when(kind.isNull(), "unsupported_type")
        .when((kind == "pdf") & F.contains(content, F.lit(b"/Encrypt")), "encrypted")
        .when(((kind == "pdf") & ~tail(2048, b"%%EOF")) | ((kind == "docx") & ~tail(66000, b"PK\x05\x06")), "corrupt")
        .when((kind == "pdf") & (pages > max_pages), "oversized")
        .when((kind == "txt") & (F.length(F.btrim(latin, F.lit(" \t\n\r\x0b\f"))) < min_chars), "empty")
    )
    mime = F.element_at(F.create_map(*(F.lit(x) for pair in MIME.items() for x in pair)), kind)
    return files.withColumn("kind", kind_of(content)).select("file_id", "kind", mime.alias("mime"), role.alias("role"), reason.alias("refused"))


#: Literal files: a head in hexadecimal, a filling that is repeated, and a tail in hexadecimal.
FILES_SCHEMA = "file_id bigint, name string, head string, fill string, times int, tail string"
FILES = [
    (-1, "Jane_Cover_Letter.pdf", PDF, "/Type /Pages /Type /Page words ", 3, "2525454F46"),
    (-2, "portfolio-2024.docx", "504B0304", "word/document.xml of some length ", 9, "504B0506"),
    (-3, "cut.docx", "504B0304", "word/document.xml of some length ", 9, ""),
    (-4, "archive.docx", "504B0304", "xl/workbook.xml ", 9, "504B0506"),
    (-5, "setup.exe", "4D5A9000", "words ", 99, ""),
    (-6, "cut_resume.pdf", PDF, "/Type /Page ", 2, ""),
    (-7, "locked.pdf", PDF, "/Type /Page /Encrypt ", 1, ""),
    (-8, "long.pdf", PDF, "/Type /Page ", 9, "2525454F46"),
    (-9, "cv.txt", "48656C6C6F", "  ", 400, ""),
    (-10, "notes.md", "7F454C46", "words ", 99, ""),
    (-11, "run.txt", "2321", "words ", 99, ""),
    (-12, "broken.txt", "FF", "words ", 99, ""),
    (-13, "control.txt", "010203", "ab", 9, ""),
    (-14, "nothing.txt", "", "", 0, ""),
    (-15, "huge.txt", "48", "words ", 20000, ""),
]
LIMITS = {"max_bytes": 100_000, "max_pages": 8, "min_chars": MIN_CHARS}


def intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 to C3, C5, C6 on every document's bytes and on literal files, with lower limits of size and pages than the usual ones."""
    literal = fixtures.frame(spark, FILES_SCHEMA, FILES)
    content = F.concat(F.unhex("head"), F.encode(F.expr("repeat(fill, times)"), "UTF-8"), F.unhex("tail"))
    docs = spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.col("source"), F.lit(".txt")).alias("name"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")))
    return classified(docs.unionByName(literal.select("file_id", "name", content.alias("content"))), **LIMITS)


def capped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: of each candidate's documents, the first eight by id."""
    docs = read_table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("candidate"), "doc_id")
    nth = F.row_number().over(Window.partitionBy("candidate").orderBy("doc_id"))
    return docs.withColumn("nth", nth).where(F.col("nth") <= 8).select("candidate", "doc_id", F.col("nth").cast("bigint").alias("nth"))


def normal_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SHA-256 of the normal and of the folded form of every text."""
    return sources(spark, sf_dir).select("id", F.sha2(T.normalised(F.col("text")), 256).alias("normal"), F.sha2(T.folded(F.col("text")), 256).alias("folded"))


def redactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts that redaction changes, with how many addresses and phone numbers went."""
    out = T.redacted(F.col("text"))
    count = lambda kind: F.regexp_count(out, F.lit(rf"\[redacted:{kind}\]")).cast("bigint").alias(f"n_{kind}")
    changed = sources(spark, sf_dir).select("id", F.sha2(out, 256).alias("sha256"), count("email"), count("phone"))
    return changed.where((F.col("n_email") > 0) | (F.col("n_phone") > 0))


def protected_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """texts that name a protected attribute outside its technical senses."""
    found = sources(spark, sf_dir).select("id", F.array_join(T.protected_terms(F.col("text"), ("shoe_size",)), ",").alias("terms"))
    return found.where(F.col("terms") != "")


def masked_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """a map of fields with secrets dropped, quotations cut to 120 characters and the rest redacted."""
    fields = F.create_map(F.lit("token"), F.lit("abc"), F.lit("excerpt"), "text", F.lit("note"), "text")
    value = lambda k, v: F.when(k.isin("api_key", "authorization", "token", "secret", "password"), "[redacted:secret]").when(k.isin("verbatim_span", "span", "quotation", "excerpt", "raw_text"), F.substring(v, 1, 120)).otherwise(T.redacted(v))
    masked = fixtures.texts(spark).select("fx_id", F.transform_values(fields, value).alias("m"))
    return masked.select("fx_id", F.explode("m").alias("field", "value")).select("fx_id", "field", F.sha2("value", 256).alias("sha256"))


BLOCKS_SCHEMA = "page bigint, block bigint, x0 double, y0 double, x1 double, width double, text string"
BLOCKS = [
    (1, 1, 50.0, 100.0, 250.0, 600.0, "left top"), (1, 2, 320.0, 90.0, 550.0, 600.0, "right top"), (1, 3, 50.0, 300.0, 250.0, 600.0, "left low"),
    (1, 4, 320.0, 300.0, 550.0, 600.0, "right low"), (2, 5, 50.0, 90.0, 550.0, 600.0, "one"), (2, 6, 52.0, 200.0, 548.0, 600.0, "two"), (2, 7, 50.0, 150.0, 550.0, 600.0, " "),
    (3, 8, 50.0, 90.04, 200.0, 600.0, "b"), (3, 9, 40.0, 90.0, 205.0, 600.0, "a"),
]


def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by gaps between block centres, order within them, and where each block starts in the page."""
    blocks = fixtures.frame(spark, BLOCKS_SCHEMA, BLOCKS).where(F.trim("text") != "").withColumn("centre", (F.col("x0") + F.col("x1")) / 2)
    by_centre = Window.partitionBy("page").orderBy("centre", "block")
    gap = F.coalesce(F.col("centre") - F.lag("centre").over(by_centre) > 0.15 * F.col("width"), F.lit(False)).cast("int")
    columns = blocks.withColumn("gap", gap).withColumn("column", F.sum("gap").over(by_centre))
    in_order = Window.partitionBy("page").orderBy("column", F.bround("y0", 1), "x0", "block")
    before = F.coalesce(F.sum(F.length(F.trim("text")) + 1).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return columns.select("page", "block", F.col("column").cast("bigint").alias("column"), F.row_number().over(in_order).cast("bigint").alias("place"), before.cast("bigint").alias("start"))


def page_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: where each starts and ends when joined by a blank line that belongs to the page before."""
    by_page = Window.partitionBy("conv_id").orderBy("turn")
    pages = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"), F.lead("turn").over(by_page).isNull().alias("last"))
    length = F.col("n") + F.when(F.col("last"), 0).otherwise(2)
    end = F.sum(length).over(by_page.rowsBetween(Window.unboundedPreceding, 0))
    return pages.select("conv_id", "turn", (end - length).cast("bigint").alias("start"), end.cast("bigint").alias("stop"))


LEAST_SAMPLE, SAMPLE_CHARS, DOMINANCE = 40, 1500, 0.6
#: Languages that a policy allows, and those whose quality is measured.
ALLOWED_LANGUAGES, MEASURED_LANGUAGES = ("en",), ("en", "ko")


def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language that most samples of a source have, of equals the first seen, with its share; mixed under 0.6.

    A document is a page of its source, its first 1500 characters the sample; samples of under 40 characters, and those of no
    language, have no vote. The score is 1 for a source of one language, a half for a mixed one, 0 where nothing had a vote.
    """
    c = F.col
    voting = (F.length(F.trim(F.substring("text", 1, SAMPLE_CHARS))) >= LEAST_SAMPLE) & c("lang").isNotNull()
    rows = read_table(spark, sf_dir, "documents").select("source", "doc_id", F.when(F.coalesce(voting, F.lit(False)), c("lang")).alias("lang"))
    counts = rows.groupBy("source", "lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen"))
    real = c("lang").isNotNull()
    top = counts.groupBy("source").agg(F.max_by(F.struct("lang", "n"), F.when(real, F.struct(c("n"), -c("seen")))).alias("t"), F.coalesce(F.sum(F.when(real, c("n"))), F.lit(0)).alias("all"))
    none, share = c("all") == 0, c("t.n") / F.nullif("all", F.lit(0))
    mixed = share < DOMINANCE
    dominant = F.when(~none, c("t.lang"))
    return top.select(
        "source", dominant.alias("dominant"), F.when(~none, share).alias("share"), F.when(mixed, "mixed").otherwise(dominant).alias("language"), F.when(none, 0.0).when(mixed, 0.5).otherwise(1.0).alias("score"),
        F.coalesce(dominant.isin(*ALLOWED_LANGUAGES), F.lit(False)).alias("allowed"), F.coalesce(dominant.isin(*MEASURED_LANGUAGES), F.lit(False)).alias("measured"),
    )


LEAST_PAGE_CHARS = 50


def extraction_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation as a document the weighted parts of confidence: pages with text, method, structure, language.

    A page read by character recognition counts with its own confidence, any other fully. Language is 1 where all pages are of
    one script, else a half.
    """
    text = F.coalesce("text", F.lit(""))
    sure = F.when(F.col("turn") % 3 == 2, (F.col("conv_id") * 7 + F.col("turn")) % 100 / 100).otherwise(1.0)
    pages = read_table(spark, sf_dir, "conversations").select("conv_id", F.length(text).alias("n"), F.size(F.split(text, "\n")).alias("blocks"), sure.alias("sure"), F.regexp_like(text, F.lit(r"[^\x00-\x7F]")).alias("wide"))
    part = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    parts = pages.groupBy("conv_id").agg(
        part(F.col("n") >= LEAST_PAGE_CHARS).alias("coverage"), F.avg("sure").alias("method"), part(F.col("blocks") > 1).alias("structure"), F.when(F.bool_or("wide") == F.bool_and("wide"), 1.0).otherwise(0.5).alias("language")
    )
    score = 0.4 * F.col("coverage") + 0.3 * F.col("method") + 0.2 * F.col("structure") + 0.1 * F.col("language")
    names = ("coverage", "method", "structure", "language")
    return parts.select("conv_id", *(F.round(c, 6).alias(c) for c in names), F.round(F.least(score, F.lit(1.0)), 6).alias("confidence"))


QUERIES = {
    "document_hashes": (document_hashes, "SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_id, count(*) AS n_copies, max(octet_length(encode(coalesce(text, ''))))::BIGINT AS n_bytes FROM documents GROUP BY 1"),
    "content_keys": (content_keys, f"""SELECT doc_id // 5 AS candidate, sha256(concat_ws(chr(31), string_agg(sha, chr(31) ORDER BY sha), {", ".join(f"'{c}'" for c in CONFIG)})) AS content_key
        FROM (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents) GROUP BY 1"""),
    "intake": (intake, f"""WITH {fixtures.sql("fx", FILES_SCHEMA, FILES)}, f AS (SELECT doc_id AS file_id, source || '.txt' AS name, hex(encode(coalesce(text, ''))) AS h FROM documents UNION ALL SELECT file_id, name, head || hex(encode(repeat(fill, times))) || tail FROM fx),
        s AS (SELECT *, length(h) // 2 AS n, lower(name) AS l, TRY(decode(unhex(substring(h, 1, {2 * SAMPLE_BYTES})))) AS t FROM f),
        k AS (SELECT *, CASE WHEN n = 0 OR {" OR ".join(f"starts_with(h, '{m}')" for m in PROGRAMS)} THEN NULL WHEN starts_with(h, '{PDF}') THEN 'pdf'
            WHEN {" OR ".join(f"starts_with(h, '{m}')" for m in ZIPS)} THEN CASE WHEN contains(left(h, {2 * HEAD_BYTES}), '{WORD_PART.hex().upper()}') OR contains(right(h, {2 * HEAD_BYTES}), '{WORD_PART.hex().upper()}') THEN 'docx' END
            WHEN length(t) - len(regexp_extract_all(t, '{UNSEEN}')) + len(regexp_extract_all(t, '{ALLOWED}')) > {PRINTABLE_SHARE} * length(t) THEN 'txt' END AS kind FROM s),
        m(kind, mime) AS (VALUES {", ".join(f"('{k}', '{m}')" for k, m in MIME.items())})
        SELECT file_id, kind, mime, CASE WHEN l LIKE '%cover%' OR l LIKE '%letter%' THEN 'cover_letter' WHEN l LIKE '%portfolio%' OR l LIKE '%work%' THEN 'portfolio' WHEN l LIKE '%cv%' OR l LIKE '%resume%' THEN 'cv' ELSE 'other' END AS role,
            CASE WHEN n > {LIMITS["max_bytes"]} THEN 'oversized' WHEN kind IS NULL THEN 'unsupported_type' WHEN kind = 'pdf' AND contains(h, '{b"/Encrypt".hex().upper()}') THEN 'encrypted'
            WHEN (kind = 'pdf' AND NOT contains(right(h, 4096), '2525454F46')) OR (kind = 'docx' AND NOT contains(right(h, 132000), '504B0506')) THEN 'corrupt'
            WHEN kind = 'pdf' AND (length(h) - length(replace(h, '{b"/Type /Page".hex().upper()}', ''))) / 22 - (length(h) - length(replace(h, '{b"/Type /Pages".hex().upper()}', ''))) / 24 > {LIMITS["max_pages"]} THEN 'oversized'
            WHEN kind = 'txt' AND length(regexp_replace(h, '^(20|09|0A|0B|0C|0D)+|(20|09|0A|0B|0C|0D)+$', '', 'g')) < {2 * LIMITS["min_chars"]} THEN 'empty' END AS refused FROM k LEFT JOIN m USING (kind)"""),
    "capped_documents": (capped_documents, "SELECT doc_id // 20 AS candidate, doc_id, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS nth FROM documents QUALIFY nth <= 8"),
    "normal_texts": (normal_texts, f"WITH {SOURCES} SELECT id, sha256({T.normalised_sql('text')}) AS normal, sha256({T.folded_sql('text')}) AS folded FROM src"),
    "redactions": (redactions, None),
    "masked_values": (masked_values, None),
    "protected_mentions": (protected_mentions, f"""WITH {SOURCES}, c AS (SELECT id, regexp_replace(text, '{T.alternation([*T.TECHNICAL])}', ' ', 'gi') AS t FROM src),
        f AS (SELECT id, list_sort(list_distinct(list_transform(regexp_extract_all(t, '(?i){T.protected_pattern(("shoe_size",))}'), lambda x: lower(x)))) AS terms FROM c)
        SELECT id, array_to_string(terms, ',') AS terms FROM f WHERE len(terms) > 0"""),
    "reading_order": (reading_order, f"""WITH {fixtures.sql("b", BLOCKS_SCHEMA, BLOCKS)}, c AS (SELECT *, (x0 + x1) / 2 AS centre FROM b WHERE trim(text) <> ''),
        g AS (SELECT *, coalesce(centre - lag(centre) OVER (PARTITION BY page ORDER BY centre, block) > 0.15 * width, false)::INT AS gap FROM c),
        k AS (SELECT *, sum(gap) OVER (PARTITION BY page ORDER BY centre, block) AS col FROM g)
        SELECT page, block, col::BIGINT AS column, row_number() OVER w AS place, coalesce(sum(length(trim(text)) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
        FROM k WINDOW w AS (PARTITION BY page ORDER BY col, round_even(y0, 1), x0, block)"""),
    "page_tiling": (page_tiling, """WITH p AS (SELECT conv_id, turn, length(coalesce(text, '')) + CASE WHEN lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) IS NULL THEN 0 ELSE 2 END AS n FROM conversations)
        SELECT conv_id, turn, (sum(n) OVER w - n)::BIGINT AS start, (sum(n) OVER w)::BIGINT AS stop FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)"""),
    "language_vote": (language_vote, f"""WITH d AS (SELECT source, doc_id, CASE WHEN length(trim(substring(text, 1, {SAMPLE_CHARS}))) >= {LEAST_SAMPLE} THEN lang END AS lang FROM documents), c AS (SELECT source, lang, count(*) AS n, min(doc_id) AS seen FROM d WHERE lang IS NOT NULL GROUP BY ALL),
        t AS (SELECT source, lang, n, sum(n) OVER (PARTITION BY source) AS a FROM c QUALIFY row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) = 1), o AS (SELECT DISTINCT source FROM documents)
        SELECT o.source, lang AS dominant, n / a AS share, CASE WHEN n / a < {DOMINANCE} THEN 'mixed' ELSE lang END AS language, CASE WHEN a IS NULL THEN 0.0 WHEN n / a < {DOMINANCE} THEN 0.5 ELSE 1.0 END::DOUBLE AS score,
            coalesce(lang IN ('{"', '".join(ALLOWED_LANGUAGES)}'), false) AS allowed, coalesce(lang IN ('{"', '".join(MEASURED_LANGUAGES)}'), false) AS measured FROM o LEFT JOIN t ON t.source IS NOT DISTINCT FROM o.source"""),
    "extraction_confidence": (extraction_confidence, f"""WITH p AS (SELECT conv_id, coalesce(text, '') AS text, CASE WHEN turn % 3 = 2 THEN (conv_id * 7 + turn) % 100 / 100 ELSE 1.0 END AS sure FROM conversations),
        a AS (SELECT conv_id, avg((length(text) >= {LEAST_PAGE_CHARS})::INT) AS c, avg(sure::DOUBLE) AS m, avg((len(string_split(text, chr(10))) > 1)::INT) AS s, CASE WHEN count(DISTINCT regexp_matches(text, '[^\\x00-\\x7F]')) = 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS l FROM p GROUP BY conv_id)
        SELECT conv_id, round(c, 6) AS coverage, round(m, 6) AS method, round(s, 6) AS structure, l AS language, round(least(0.4::DOUBLE * c + 0.3::DOUBLE * m + 0.2::DOUBLE * s + 0.1::DOUBLE * l, 1.0), 6) AS confidence FROM a"""),
}
