"""Prompts as data: fenced blocks that a text cannot close, and the checks that a prompt file has to pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.tables import read_table

#: What a prompt file declares, and the shape of a placeholder.
REQUIRED = ("id", "version", "purpose", "inputs", "output_schema", "invariants", "forbidden")
PLACEHOLDER = r"\{([a-z_][a-z0-9_]*)\}"
#: Problems of a prompt file.
NO_FRONT, NOT_CLOSED = "the file must begin with YAML front matter", "the front matter is not closed with ---"
NO_FORBIDDEN = "forbidden must list at least one thing this prompt may never do"


def fenced(content: Column, document: Column, nonce: Column) -> Column:
    """A text in a region that only the nonce ends; an end mark without it is part of the text."""
    return F.concat(F.lit("<<<CANDIDATE_DOCUMENT id="), F.coalesce(document.cast("string"), F.lit("unknown")), F.lit(" nonce="), nonce, F.lit(">>>\n"), content, F.lit("\n<<<END "), nonce, F.lit(">>>"))


def placeholders(text: Column) -> Column:
    """Every name in braces, once each, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(1))))


def rendered_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a fenced block, whether its region holds, and whether its text stands in the system prompt, where no text of a candidate may.

    A conversation's system turns, joined, are its system prompt; the nonce is drawn from its id.
    """
    c = F.col
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    system = turns.where(c("role") == "system").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("system"))
    nonce = F.substring(F.sha2(F.concat(F.lit("block:"), c("conv_id").cast("string")), 256), 1, 16)
    blocks = turns.where(c("role") != "system").join(system, "conv_id", "left").withColumn("nonce", nonce)
    block = fenced(c("text"), c("conv_id"), c("nonce"))
    return blocks.select(
        "conv_id", "turn", F.sha2(block, 256).alias("sha256"), (~F.contains("text", "nonce")).alias("holds"),
        F.coalesce((c("text") != "") & F.contains("system", c("text")), F.lit(False)).alias("misplaced"),
    )


def problems_of(files: DataFrame) -> DataFrame:
    """(path, problem) of rows (path, text): what is wrong with each prompt file; no row means that it is sound.

    A file without front matter, or with one that is not closed, has that one problem; then come fields that are missing; then, in files with
    all of them, placeholders that are not declared, inputs that are not used, and a prohibition that names nothing. Of files with one id all but the
    first by path are duplicates. Lists are written in brackets or as lines with dashes.
    """
    c = F.col
    parts = F.split("text", "---", 3)
    rows = files.select("path", "text", F.get(parts, F.lit(1)).alias("front"), F.trim(F.get(parts, F.lit(2))).alias("body"))
    opened, closed = F.startswith("text", F.lit("---")), c("body").isNotNull()
    has = lambda f: F.regexp_like("front", F.lit(rf"(?m)^{f}:"))
    block = lambda f: F.regexp_extract("front", rf"(?m)^{f}:[ \t]*(\[[^\]]*\]|(?:\n[ \t]*- .*)+|.*)", 1)
    listed = lambda f: F.array_sort(F.array_distinct(F.regexp_extract_all(block(f), F.lit(r"([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))))
    rows = rows.withColumns({"missing": F.array_compact(F.array(*(F.when(~has(f), F.lit(f"missing required field: {f}")) for f in REQUIRED))), "inputs": listed("inputs"), "used": placeholders(c("body")), "prompt": F.trim(F.regexp_extract("front", r"(?m)^id:[ \t]*(.*)$", 1))})
    nth = F.row_number().over(Window.partitionBy("prompt").orderBy("path"))
    rows = rows.withColumn("whole", opened & closed & (F.size("missing") == 0)).withColumn("nth", F.when(c("whole"), nth).otherwise(1))
    undeclared, unused = F.array_except("used", "inputs"), F.array_except("inputs", "used")
    named = lambda text, names: F.when(F.size(names) > 0, F.concat(F.lit(text), F.array_join(names, ", ")))
    content = F.array_compact(F.array(
        named("body uses placeholders not in inputs: ", undeclared), named("inputs declared but never used: ", unused),
        F.when(F.size(listed("forbidden")) == 0, F.lit(NO_FORBIDDEN)), F.when(c("nth") > 1, F.concat(F.lit("duplicate prompt id: "), c("prompt"))),
    ))
    found = F.when(~opened, F.array(F.lit(NO_FRONT))).when(~closed, F.array(F.lit(NOT_CLOSED))).when(F.size("missing") > 0, c("missing")).otherwise(content)
    return rows.select("path", F.explode(found).alias("problem"))


def prompt_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the prompt files below ``folder``."""
    return spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


#: Front matter by a number, and what is added to the body.
FORMS_SCHEMA = "form int, front string, tail string"
_ALL = "version: 1\npurpose: ask\noutput_schema: answer\ninvariants: [none]\n"
FORMS = [
    (0, "---\nid: {id}\n" + _ALL + "inputs: [role, text]\nforbidden: [guess]\n---\n", " {role} {text}"),
    (1, "---\nid: {id}\n" + _ALL + "inputs:\n  - role\n  - extra\nforbidden:\n  - guess\n---\n", " {role} {other}"),
    (2, "---\nid: {id}\n" + _ALL + "inputs: []\nforbidden: []\n---\n", ""),
    (3, "---\nid: {id}\nversion: 1\npurpose: ask\n---\n", " {role}"),
    (4, "id: {id}\n", ""),
    (5, "---\nid: {id}\n" + _ALL, ""),
]


def prompt_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many prompts, made of the system turns of conversations in six forms of front matter, have each problem."""
    c = F.col
    turns = read_table(spark, sf_dir, "conversations").where((c("role") == "system") & c("text").isNotNull()).select("conv_id", "turn", F.replace("text", F.lit("---"), F.lit("-")).alias("text"))
    forms = F.broadcast(fixtures.frame(spark, FORMS_SCHEMA, FORMS))
    made = turns.withColumn("form", (c("conv_id") % len(FORMS)).cast("int")).join(forms, "form")
    front = F.replace("front", F.lit("{id}"), F.concat(F.lit("p"), (F.floor(c("conv_id") / 12) * 6 + c("form")).cast("string")))
    path = F.concat_ws("/", F.lpad(c("conv_id").cast("string"), 12, "0"), F.lpad(c("turn").cast("string"), 6, "0"))
    return problems_of(made.select(path.alias("path"), F.concat(front, c("text"), c("tail")).alias("text"))).groupBy("problem").agg(F.count("*").alias("n"), F.min("path").alias("first"))


_SQL_LIST = lambda f: f"list_sort(list_distinct(regexp_extract_all(regexp_extract(front, '(?m)^{f}:[ \\t]*(\\[[^\\]]*\\]|(?:\\n[ \\t]*- .*)+|.*)', 1), '([A-Za-z_][A-Za-z0-9_]*)', 1)))"
_LESS = lambda a, b: f"list_filter({a}, lambda x: NOT list_contains({b}, x))"
QUERIES = {
    "rendered_blocks": (rendered_blocks, """WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), s AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS system FROM t WHERE role = 'system' GROUP BY conv_id),
        b AS (SELECT t.*, system, substring(sha256('block:' || conv_id), 1, 16) AS nonce FROM t LEFT JOIN s USING (conv_id) WHERE role <> 'system')
        SELECT conv_id, turn, sha256('<<<CANDIDATE_DOCUMENT id=' || conv_id || ' nonce=' || nonce || '>>>' || chr(10) || text || chr(10) || '<<<END ' || nonce || '>>>') AS sha256, NOT contains(text, nonce) AS holds, coalesce(text <> '' AND contains(system, text), false) AS misplaced FROM b"""),
    "prompt_problems": (prompt_problems, f"""WITH {fixtures.sql("fm", FORMS_SCHEMA, FORMS)}, c AS (SELECT conv_id, turn, replace(text, '---', '-') AS text, conv_id % {len(FORMS)} AS form FROM conversations WHERE role = 'system' AND text IS NOT NULL),
        m AS (SELECT lpad(conv_id::VARCHAR, 12, '0') || '/' || lpad(turn::VARCHAR, 6, '0') AS path, replace(front, '{{id}}', 'p' || (conv_id // 12 * 6 + c.form)) || text || tail AS text FROM c JOIN fm USING (form)),
        p AS (SELECT path, text, string_split(text, '---') AS parts FROM m), q AS (SELECT path, starts_with(text, '---') AS opened, len(parts) > 2 AS closed, parts[2] AS front, parts[3] AS body FROM p),
        r AS (SELECT *, list_filter({[*REQUIRED]}, lambda f: NOT regexp_matches(front, '(?m)^' || f || ':')) AS missing, {_SQL_LIST("inputs")} AS inputs, {_SQL_LIST("forbidden")} AS forbidden, list_sort(list_distinct(regexp_extract_all(body, '{PLACEHOLDER}', 1))) AS used, trim(regexp_extract(front, '(?m)^id:[ \\t]*(.*)$', 1)) AS prompt FROM q),
        n AS (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY path) AS nth FROM r),
        f AS (SELECT path, unnest(CASE WHEN NOT opened THEN ['{NO_FRONT}'] WHEN NOT closed THEN ['{NOT_CLOSED}'] WHEN len(missing) > 0 THEN list_transform(missing, lambda x: 'missing required field: ' || x)
            ELSE list_filter([CASE WHEN len({_LESS("used", "inputs")}) > 0 THEN 'body uses placeholders not in inputs: ' || array_to_string({_LESS("used", "inputs")}, ', ') END, CASE WHEN len({_LESS("inputs", "used")}) > 0 THEN 'inputs declared but never used: ' || array_to_string({_LESS("inputs", "used")}, ', ') END,
                CASE WHEN len(forbidden) = 0 THEN '{NO_FORBIDDEN}' END, CASE WHEN nth > 1 THEN 'duplicate prompt id: ' || prompt END], lambda x: x IS NOT NULL) END) AS problem FROM n)
        SELECT problem, count(*) AS n, min(path) AS first FROM f GROUP BY problem"""),
}
