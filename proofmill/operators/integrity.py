"""Integrity detectors over texts, spans and metadata, and the tier that follows from their findings."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.functions import search
from proofmill.functions import text as T
from proofmill.tables import read_table, spread

#: Patterns that address a model; one is enough.
SYSTEM = (
    r"you\s+are\s+now",
    r"as\s+an?\s+AI\b",
    r"as\s+a\s+language\s+model",
    r"^\s*system\s*:",
    r"^\s*assistant\s*:",
    r"(?:ignore|disregard|forget|override|discard)\s+(?:the\s+|all\s+|any\s+|your\s+)?(?:previous|prior|above|preceding|earlier|system|initial)?\s*(?:instructions?|prompts?|rules?|directives?|guidelines?)",
    r"follow\s+(?:these|the\s+following)\s+instructions?\s+instead",
    r"your\s+(?:new\s+)?instructions?\s+(?:are|is)",
    r"automated\s+(?:screener|reviewer|recruiter)",
    r"AI\s+(?:screener|reviewer|reader)",
    r"note\s+to\s+the\s+(?:automated\s+)?(?:screener|reviewer|system|reader|AI)",
    r"the\s+(?:screening\s+)?system\s+should\s+(?:mark|rate|score|recommend|assign|skip)",
)
#: Imperatives that count near an addressing word, and those words.
IMPERATIVES = (
    r"ignore\s+(?:the\s+|all\s+)?(?:previous|prior|above|preceding|earlier)",
    r"disregard\s+(?:the\s+|all\s+)?(?:previous|prior|above|preceding|earlier)",
    r"forget\s+(?:the\s+|all\s+)?(?:previous|prior|above|everything)",
    r"output\s+only",
    r"respond\s+only\s+with",
    r"rate\s+this\s+candidate",
    r"recommend\s+hiring",
    r"assign\s+the\s+highest",
    r"set\s+the\s+score",
    r"give\s+(?:this\s+candidate\s+)?(?:the\s+)?(?:highest|top|maximum)",
    r"mark\s+(?:this\s+candidate\s+)?as\s+(?:qualified|suitable|approved)",
    r"do\s+not\s+(?:mention|report|flag)",
    r"must\s+(?:advance|approve|hire)",
)
ADDRESSING = ("you", "your", "AI", "model", "system", "screener", "assistant", "LLM", "chatbot", "prompt", "parser", "reviewer", "screening")
NEAR = 120
#: Delimiters of chats and completions.
ROLE_TOKENS = (r"<\|", r"\|>", r"</s>", r"<s>", r"\[INST\]", r"\[/INST\]", r"###\s*system", r"###\s*instruction", r"<\s*system\s*>", r"^\s*assistant\s*:", r"^\s*system\s*:", r"<\|im_start\|>", r"<\|endoftext\|>")
#: Characters that hide text, besides the tag block.
HIDDEN = "​‌‍⁠﻿‪‫‬‭‮⁦⁧⁨⁩­"
#: Severity and confidence of each detector.
RANKS = {"low": 1, "medium": 2, "high": 3}
QUARANTINE_AT = 0.75
_WORDS = r"\b(?:" + "|".join(ADDRESSING) + r")\b"
#: The names of hidden characters, in the order of HIDDEN, and of the tag block.
HIDDEN_NAMES = (
    "zero-width space",
    "zero-width non-joiner",
    "zero-width joiner",
    "word joiner",
    "zero-width no-break space",
    "left-to-right embedding",
    "right-to-left embedding",
    "pop directional formatting",
    "left-to-right override",
    "right-to-left override",
    "left-to-right isolate",
    "right-to-left isolate",
    "first strong isolate",
    "pop directional isolate",
    "soft hyphen",
)
TAGS = r"\x{E0000}-\x{E007F}"
#: What an excerpt shows: characters before a hit, after the start of an instruction or a role mark, and at most.
BEFORE, AFTER_INSTRUCTION, AFTER_ROLE, EXCERPT = 40, 200, 160, 240
#: White space of any script; an excerpt is one line.
SPACES = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def near_pattern(pattern: str) -> str:
    """An imperative with an addressing word within NEAR characters of its start, on either side, the word inside as a whole.

    A word that ends or begins just where the reach does counts whatever follows or precedes it there.
    """
    before, after = [], []
    for size in sorted({len(w) for w in ADDRESSING}):
        words, room = "(?:" + "|".join(w for w in ADDRESSING if len(w) == size) + ")", NEAR - size
        before += [rf"\b{words}\b[\s\S]{{0,{room}}}", rf"{words}\b[\s\S]{{{room}}}"]
        after += [rf"[\s\S]{{0,{room}}}\b{words}\b", rf"[\s\S]{{{room}}}\b{words}"]
    return f"(?={pattern})(?:(?<={'|'.join(before)})|(?={'|'.join(after)}))(?:{pattern})"


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the literal rows as (id, text)."""
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")).unionAll(fixtures.texts(spark))


SOURCES = f"{fixtures.TEXTS_SQL}, src AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT fx_id, text FROM fx)"


def finding(when: Column, detector: str, severity: Column | str, confidence: Column | float, excerpt: Column) -> Column:
    """A finding where ``when`` holds, else null."""
    level = F.lit(severity) if isinstance(severity, str) else severity
    sure = F.lit(confidence) if isinstance(confidence, float) else confidence
    line = F.trim(F.regexp_replace(excerpt, SPACES, " "))
    short = F.when(F.length(line) <= EXCERPT, line).otherwise(F.concat(F.substring(line, 1, EXCERPT - 1), F.lit("…")))
    return F.when(when, F.struct(F.lit(detector).alias("detector"), level.alias("severity"), sure.cast("double").alias("confidence"), short.alias("excerpt")))


#: Of each pattern, in its bank's order, words of which a match has to hold one (in lower case); every one of a tuple within is needed.
SYSTEM_WORDS = (
    (("you", "now"),), tuple(("as", f"{blank}ai") for blank in " \t\n\x0b\f\r"), (("language", "model"),), (("system", ":"),), (("assistant", ":"),), ("ignore", "disregard", "forget", "override", "discard"),
    (("follow", "instead"),), (("your", "instruction"),), ("automated",), ("screener", "reviewer", "reader"), (("note", "the"),), (("system", "should"),),
)
IMPERATIVE_WORDS = (
    ("ignore",), ("disregard",), ("forget",), (("output", "only"),), (("respond", "with"),), (("rate", "candidate"),), (("recommend", "hiring"),), (("assign", "highest"),), (("set", "score"),),
    (("give", "highest"), ("give", "top"), ("give", "maximum")), (("mark", "qualified"), ("mark", "suitable"), ("mark", "approved")), (("not", "mention"), ("not", "report"), ("not", "flag")),
    (("must", "advance"), ("must", "approve"), ("must", "hire")),
)
ROLE_WORDS = ("<", "|>", "inst]", "###", ("assistant", ":"), ("system", ":"))
#: The words by which a text is looked through once, as a group for each pattern of the banks and one for all role marks.
WORD_GROUPS = (*SYSTEM_WORDS, *IMPERATIVE_WORDS, ROLE_WORDS)
#: What a lower-case text has to hold besides, where a group's words are common by themselves: "as" and " ai" are in one text of eight.
NEEDED = {1: rb"as\s+an?\s+ai"}
#: A phrase more often than this is a repetition.
MOST = 6


def holds(lower: Column, words: tuple) -> Column:
    """Whether a lower-case text holds one of the words; plain searches cost a tenth of a pattern's."""
    every = lambda w: reduce(and_, (F.contains(lower, F.lit(x)) for x in ((w,) if isinstance(w, str) else w)))
    return reduce(or_, map(every, words))


def has_odd(text: Column) -> Column:
    """Whether a text has a soft hyphen or a character beyond U+00FF, as all hidden ones, Greek and Cyrillic are; most texts are of one byte a character."""
    return (F.octet_length(text) != F.char_length(text)) & F.regexp_like(text, F.lit(r"[^\x00-\xAC\xAE-\xFF]"))


def first_places(text: Column, patterns: list[str] | tuple[str, ...]) -> Column:
    """Of the patterns that match, in their order, the place of each one's first match, from 0."""
    place = lambda p: F.when(F.regexp_like(text, p), F.length(F.element_at(F.split(text, p, 2), 1)))
    return F.array_compact(F.transform(F.array(*(F.lit(f"(?im){p}") for p in patterns)), place))


def around(text: Column, place: Column, after: int) -> Column:
    """The text about a hit."""
    start = F.greatest(place - BEFORE, F.lit(0))
    return F.substring(text, start + 1, place + after - start)


def looked_up(lower: Column) -> Column:
    """What a lower-case text holds, as (groups, phrase, times): which of WORD_GROUPS and, as one group more, odd characters, and its most frequent phrase if that is a repetition.

    Texts pass through Arrow batches once, many at a time; nothing leaves its row, so nothing is shuffled.
    """

    def run(texts: pa.Array) -> pa.Array:
        return search.looked_up(texts, WORD_GROUPS, MOST, NEEDED)

    return F.arrow_udf(run, "groups bigint, phrase string, times int")(lower)


def has_group(groups: Column, number: int) -> Column:
    """Whether a text was found to hold words of a group."""
    return groups.bitwiseAND(F.lit(1 << number).cast("bigint")) != 0


def instruction_places(text: Column, groups: Column) -> tuple[Column, Column]:
    """Places of the system and imperative patterns of a text; a pattern is tried only where its words are, and nearly no text is searched for each pattern."""
    tried = lambda p, n, words: has_group(groups, n) & holds(F.lower(text), words) & F.regexp_like(text, F.lit(f"(?im){p}"))
    any_of = reduce(or_, (tried(p, n, words) for n, (p, words) in enumerate(zip((*SYSTEM, *IMPERATIVES), (*SYSTEM_WORDS, *IMPERATIVE_WORDS), strict=True))))
    every = lambda patterns: F.when(any_of, first_places(text, patterns)).otherwise(F.array().cast("array<int>"))
    return every(SYSTEM), every([near_pattern(p) for p in IMPERATIVES])


def instructions(text: Column, system: Column, near: Column) -> Column:
    """Text that instructs a reader, by the places of its patterns; the excerpt is about the earliest, system patterns first."""
    s, n = F.size(system), F.size(near)
    severity = F.when((s > 0) | (n > 1), "high").otherwise("medium")
    first = F.coalesce(F.array_min(system), F.array_min(near))
    return finding((s > 0) | (n > 0), "instructions", severity, F.when(s > 0, 0.9).when(n > 1, 0.8).otherwise(0.55), around(text, first, AFTER_INSTRUCTION))


def role_tokens(text: Column, groups: Column) -> Column:
    """Delimiters of chats; the excerpt is about the first delimiter of the list that is there."""
    found = has_group(groups, len(WORD_GROUPS) - 1) & F.regexp_like(text, F.lit("(?im)" + "|".join(f"(?:{p})" for p in ROLE_TOKENS)))
    return finding(found, "role_tokens", "high", 0.95, around(text, F.get(first_places(text, ROLE_TOKENS), F.lit(0)), AFTER_ROLE))


def hidden_characters(text: Column, odd: Column) -> Column:
    """Characters that hide text, counted by name on the raw text; the most frequent first, then as they come."""
    classes = [*zip(HIDDEN, HIDDEN_NAMES, strict=True), (TAGS, "tag character")]
    named = F.array(*(F.struct(F.lit(f"[{c}]").alias("c"), F.lit(name).alias("name")) for c, name in classes))
    counted = F.transform(
        named,
        lambda x: F.struct(
            (F.length(F.regexp_replace(text, x["c"], "")) - F.length(text)).alias("less"),
            F.length(F.element_at(F.split(text, x["c"], 2), 1)).alias("place"),
            x["name"].alias("name"),
        ),
    )
    listed = F.transform(F.array_sort(F.filter(counted, lambda x: x["less"] < 0)), lambda x: F.concat(x["name"], F.lit(" ("), -x["less"], F.lit(")")))
    excerpt = F.concat(F.lit("invisible characters present: "), F.array_join(listed, ", "))
    return finding(odd & F.regexp_like(text, F.lit(f"[{HIDDEN}{TAGS}]")), "hidden_characters", "medium", 0.7, excerpt)


def mixed_scripts(text: Column, odd: Column) -> Column:
    """Words of three letters or more with Latin and Cyrillic or Greek letters; the first eight by code point are named."""
    word = r"(?U)\b(?=\w{3})(?=\w*\p{IsLatin})(?=\w*[\p{IsCyrillic}\p{IsGreek}])\w+"
    words = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(word), F.lit(0)))), 1, 8)
    return finding(odd & F.regexp_like(text, F.lit(word)), "mixed_scripts", "medium", 0.75, F.concat(F.lit("mixed-script words: "), F.array_join(words, ", ")))


def repetition(phrase: Column, times: Column) -> Column:
    """A three-word phrase more than six times, whatever lies between its words; the most frequent is named, of equals the first."""
    return finding(times > MOST, "repetition", "low", 0.6, F.concat(F.lit('"'), phrase, F.lit('" appears '), times, F.lit(" times")))


def found_in(texts: DataFrame) -> DataFrame:
    """(id, found): the findings of all text detectors as an array, in one pass over the texts.

    What several expressions need is a column first, so it is computed once. Words are a-z, three letters or more. If ``texts`` has
    a column ``raw``, hidden characters are looked for there: a normal form has none left.
    """
    c = F.col
    own = ["id", "text", *(["raw"] if "raw" in texts.columns else [])]
    # Lower case keeps hidden characters, and Greek and Cyrillic letters beyond U+00FF.
    raw, odd = own[-1], [has_group(c("u.groups"), len(WORD_GROUPS)).alias("odd_text"), *(has_odd(c(x)).alias(f"odd_{x}") for x in own[2:])]
    looked = texts.select(*own, looked_up(F.lower("text")).alias("u"))
    system, near = instruction_places(c("text"), c("u.groups"))
    placed = looked.select(*own, *odd, "u", system.alias("s"), near.alias("n"))
    each = [instructions(c("text"), c("s"), c("n")), role_tokens(c("text"), c("u.groups")), hidden_characters(c(raw), c(f"odd_{raw}")), mixed_scripts(c("text"), c("odd_text")), repetition(c("u.phrase"), c("u.times"))]
    return placed.select("id", F.array_compact(F.array(*each)).alias("found"))


def findings(texts: DataFrame) -> DataFrame:
    """All findings of the text detectors in one schema (id, detector, severity, confidence, excerpt)."""
    # An inner explode would have the optimiser test the array beforehand, and so find everything twice.
    return found_in(texts).select("id", F.explode_outer("found").alias("f")).where(F.col("f").isNotNull()).select("id", "f.*")


def text_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1, E2, E6, E7, E9, E11 on documents and literal rows."""
    return findings(sources(spark, sf_dir))


def _rank(severity: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in RANKS.items() for x in pair)), severity)


def tiers(found: DataFrame, everything: DataFrame) -> DataFrame:
    """Quarantine for a sure high finding, suspect for any high or medium one, else clean."""
    worst = found.groupBy("id").agg(F.max(F.when((F.col("severity") == "high") & (F.col("confidence") >= QUARANTINE_AT), 2).when(_rank(F.col("severity")) >= 2, 1).otherwise(0)).alias("t"))
    level = F.coalesce("t", F.lit(0))
    return everything.select("id").join(worst, "id", "left").select("id", F.when(level == 2, "quarantine").when(level == 1, "suspect").otherwise("clean").alias("tier"))


def integrity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tier of every text, from its own findings: nothing is joined or shuffled."""
    sure = F.exists("found", lambda f: (f["severity"] == "high") & (f["confidence"] >= QUARANTINE_AT))
    some = F.exists("found", lambda f: f["severity"] != "low")
    return found_in(sources(spark, sf_dir)).select("id", F.when(sure, "quarantine").when(some, "suspect").otherwise("clean").alias("tier"))


def worst_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worst tier of each source."""
    rank = F.element_at(F.create_map(*(F.lit(x) for pair in (("clean", 0), ("suspect", 1), ("quarantine", 2)) for x in pair)), F.col("tier"))
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    joined = integrity_tiers(spark, sf_dir).join(docs, "id")
    return joined.groupBy("source").agg(F.max(rank).alias("rank"), F.count_if(F.col("tier") != "clean").alias("n_flagged"))


#: Spans of a rendered page: id, length of stripped text, font size, opacity, colour and background (red, green, blue), box, visible box, behind an image.
SPANS_SCHEMA = "span_id bigint, chars int, font double, alpha double, r double, g double, b double, br double, bg double, bb double, x0 double, y0 double, x1 double, y1 double, vx0 double, vy0 double, vx1 double, vy1 double, behind boolean"
_INK, _NEAR_WHITE, _PAPER, _BOX, _PAGE = (0.0, 0.0, 0.1), (1.0, 0.92, 0.95), (1.0, 1.0, 1.0), (10.0, 10.0, 90.0, 20.0), (0.0, 0.0, 600.0, 800.0)
SPANS = [
    (1, 40, 11.0, 1.0, *_NEAR_WHITE, *_PAPER, *_BOX, *_PAGE, False),
    (2, 39, 11.0, 1.0, *_PAPER, *_PAPER, *_BOX, *_PAGE, False),
    (3, 50, 2.9, 1.0, *_INK, *_PAPER, *_BOX, *_PAGE, False),
    (4, 50, 3.0, 1.0, 1.0, 1.0, 0.9, *_PAPER, *_BOX, *_PAGE, False),
    (5, 60, 11.0, 0.04, *_INK, *_PAPER, *_BOX, *_PAGE, False),
    (6, 60, 11.0, 1.0, *_INK, *_PAPER, 610.0, 10.0, 690.0, 20.0, *_PAGE, False),
    (7, 60, 11.0, 1.0, *_INK, *_PAPER, 600.0, 10.0, 690.0, 20.0, *_PAGE, False),
    (8, 60, 11.0, 1.0, *_INK, *_PAPER, *_BOX, *_PAGE, True),
    (9, 60, 11.0, 1.0, *_INK, *_PAPER, *_BOX, 0.0, 30.0, 600.0, 800.0, False),
    (10, 60, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, False),
]
LEAST_RUN, INVISIBLE_ALPHA, LEAST_CONTRAST, LEAST_FONT = 40, 0.05, 0.08, 3.0


def hidden_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 40 characters or more in the background's colour, under 3 points, or out of the visible box or behind an image.

    Contrast is the largest difference of a channel, to six places. What a span does not say hides nothing.
    """
    c = F.col
    rows = fixtures.frame(spark, SPANS_SCHEMA, SPANS).where(c("chars") >= LEAST_RUN)
    contrast = F.round(F.greatest(*(F.abs(c(x) - c("b" + x)) for x in "rgb")), 6)
    off = (c("x1") < c("vx0")) | (c("x0") > c("vx1")) | (c("y1") < c("vy0")) | (c("y0") > c("vy1")) | c("behind")
    found = lambda when, kind, sure: F.when(when, F.struct(F.lit(kind).alias("kind"), F.lit(sure).alias("confidence")))
    kinds = F.array_compact(F.array(found((c("alpha") < INVISIBLE_ALPHA) | (contrast <= LEAST_CONTRAST), "colour", 0.9), found(c("font") < LEAST_FONT, "size", 0.9), found(off, "off_page", 0.85)))
    return rows.select("span_id", F.explode(kinds).alias("k")).select("span_id", "k.kind", F.lit("high").alias("severity"), "k.confidence")


#: The metadata fields that are read.
METADATA_FIELDS = ("title", "subject", "keywords", "author", "creator", "comments", "description", "category", "content_status")
#: Those that a page states, as a pattern with the value in its first group.
PAGE_FIELDS = {"title": "(?is)<title[^>]*>(.*?)</title>", **{f: f'(?is)<meta\\s+name="{f}"\\s+content="([^"]*)"' for f in ("description", "keywords", "author")}}


def metadata_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata fields of pages and literal rows with an instruction of either bank, without regard to what stands near it.

    Fields that are not on the list, and empty ones, are not read.
    """
    pairs = lambda named: F.explode(F.create_map(*(x for name, value in named for x in (F.lit(name), value)))).alias("field", "value")
    stated = [(f, F.regexp_extract(F.coalesce("html", F.lit("")), p, 1)) for f, p in PAGE_FIELDS.items()]
    pages = read_table(spark, sf_dir, "pages").select(F.lit("page").alias("of"), F.col("page_id").alias("id"), pairs(stated))
    literal = fixtures.texts(spark).select(F.lit("literal").alias("of"), F.col("fx_id").alias("id"), pairs([("subject", F.col("text")), ("comments", F.reverse("text")), ("private", F.col("text"))]))
    pattern = "(?im)" + "|".join(f"(?:{p})" for p in (*SYSTEM, *IMPERATIVES))
    read = pages.unionByName(literal).where(F.col("field").isin(*METADATA_FIELDS) & (F.col("value") != ""))
    f = finding(F.regexp_like("value", F.lit(pattern)), "metadata", "high", 0.9, F.concat_ws(": ", "field", "value"))
    return read.select("of", "id", "field", f.alias("f")).where(F.col("f").isNotNull()).select("of", "id", "field", "f.severity", "f.confidence", "f.excerpt")


def render_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page's raw text says and its rendering does not; a page of which nothing was rendered has no finding.

    Sentences end at a line break or at a full stop, question or exclamation mark that a blank follows. Those of four words or more
    of which under 60 % are among the rendered words count, on pages where they have 60 characters or more, joined by blanks.
    The raw text keeps scripts, comments and styles; the rendering drops them.
    """
    return missing_sentences(read_table(spark, sf_dir, "pages")).select("page_id", "n_sentences", "n_chars")


def missing_sentences(pages: DataFrame) -> DataFrame:
    """(page_id, n_sentences, n_chars, missing) of rows (page_id, html): pages with enough unseen text, and the text, its sentences joined by blanks."""
    pages = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html"))
    shown = F.regexp_replace(F.regexp_replace(F.col("html"), r"(?s)<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<!--.*?-->", " "), "<[^>]*>", " ")
    raw = F.regexp_replace(F.col("html"), "<[^>]*>", " ")
    words = lambda t: F.regexp_extract_all(F.lower(t), F.lit("[a-z0-9]+"), F.lit(0))
    sides = pages.select("page_id", raw.alias("raw"), F.array_distinct(words(shown)).alias("seen")).where(F.size("seen") > 0)
    trimmed = F.regexp_replace("s", r"^\s+|\s+$", "")
    sentences = sides.select("page_id", "seen", F.posexplode(F.split("raw", r"(?<=[.!?])\s+|\n+")).alias("at", "s")).select("page_id", "seen", "at", trimmed.alias("s"), words(F.col("s")).alias("w"))
    # Bound as a lambda's variable, the new words of a sentence are found once, not again for each word.
    unknown = F.get(F.transform(F.array(F.array_except("w", "seen")), lambda new: F.size(F.filter("w", lambda x: F.array_contains(new, x)))), F.lit(0))
    missing = sentences.where((F.size("w") >= 4) & (F.size("w") - unknown < 0.6 * F.size("w"))).groupBy("page_id").agg(
        F.count("*").alias("n_sentences"), (F.sum(F.length("s") + 1) - 1).alias("n_chars"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "s"))), lambda x: x["s"]), " ").alias("missing")
    )
    return missing.where(F.col("n_chars") >= 60)


NO_PAGES = "this document has no pages to compare"


def document_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every finding of every detector in one table (of, id, detector, severity, confidence, excerpt), and why a check did not run (``skipped``).

    Instructions, role marks, scripts and repetition are looked for in the normal form, which is what a reader is shown, hidden characters
    in the raw text. Pages are also held against their rendering and have metadata; texts have no pages, which is recorded.
    """
    c = F.col
    texts = sources(spark, sf_dir).select("id", T.normalised(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("text", F.lit("")).alias("raw"))
    none = F.lit(None).cast("string")
    names = ("detector", "severity", "confidence", "excerpt")
    in_texts = findings(texts).select(F.lit("text").alias("of"), "id", *names, none.alias("skipped"))
    not_run = texts.select(F.lit("text").alias("of"), "id", F.lit("render_difference").alias("detector"), none.alias("severity"), F.lit(None).cast("double").alias("confidence"), none.alias("excerpt"), F.lit(NO_PAGES).alias("skipped"))
    unseen = missing_sentences(read_table(spark, sf_dir, "pages"))
    f = finding(F.lit(True), "render_difference", "high", 0.82, F.concat(F.lit("page 1: "), c("missing")))
    in_pages = unseen.select(F.lit("page").alias("of"), c("page_id").alias("id"), f.alias("f")).select("of", "id", *(f"f.{n}" for n in names), none.alias("skipped"))
    metadata = metadata_findings(spark, sf_dir).select("of", "id", F.lit("metadata").alias("detector"), "severity", "confidence", "excerpt", none.alias("skipped"))
    return in_texts.unionAll(not_run).unionAll(in_pages).unionAll(metadata)


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_ANY = lambda bank: "|".join(f"(?:{p})" for p in bank)
_SPLIT = lambda p: f"string_split_regex(text, '(?im){_re2(p)}')"
_PLACE = lambda p: f"CASE WHEN regexp_matches(text, '{_re2(p)}', 'im') THEN length({_SPLIT(p)}[1]) END"
_PLACES = lambda bank: "list_filter([" + ", ".join(map(_PLACE, bank)) + "], lambda x: x IS NOT NULL)"
#: All places of an imperative that have an addressing word in the text cut out about them; the least of them.
_NEAR_PLACE = lambda p: (
    f"list_min(list_filter(list_transform(range(1, len({_SPLIT(p)})), lambda k: list_sum(list_transform({_SPLIT(p)}[1:k], lambda x: length(x)))"
    f" + coalesce(list_sum(list_transform(regexp_extract_all(text, '(?im){_re2(p)}')[1:k - 1], lambda x: length(x))), 0)),"
    f" lambda spot: regexp_matches(substring(text, greatest(spot - {NEAR}, 0)::BIGINT + 1, least(spot, {NEAR})::BIGINT + {NEAR}), '{_WORDS}', 'i')))"
)
_NEAR_PLACES = "list_filter([" + ", ".join(map(_NEAR_PLACE, IMPERATIVES)) + "], lambda x: x IS NOT NULL)"
_AROUND = lambda at, after: f"substring(text, greatest({at} - {BEFORE}, 0)::BIGINT + 1, (least({at}, {BEFORE}) + {after})::BIGINT)"
_MARKS = ", ".join(f"('{c if c == TAGS else f'\\x{{{ord(c):X}}}'}', '{name}')" for c, name in [*zip(HIDDEN, HIDDEN_NAMES, strict=True), (TAGS, "tag character")])
_LINE = f"trim(regexp_replace(excerpt, '{SPACES}', ' ', 'g'), ' ')"
_SHORT = f"CASE WHEN length({_LINE}) <= {EXCERPT} THEN {_LINE} ELSE substring({_LINE}, 1, {EXCERPT - 1}) || '…' END"
_FOUND = f"""{SOURCES}, i AS (SELECT id, text, {_PLACES(SYSTEM)} AS s, {_NEAR_PLACES} AS n FROM src WHERE regexp_matches(text, '{_re2(_ANY((*SYSTEM, *IMPERATIVES)))}', 'im')),
g AS (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda k: (k, array_to_string(w[k : k + 2], ' ')))) AS p FROM (SELECT id, regexp_extract_all(lower(text), '[a-z]{{3,}}') AS w FROM src) WHERE len(w) >= 3),
gc AS (SELECT id, p[2] AS phrase, count(*) AS c, min(p[1]) AS k FROM g GROUP BY ALL HAVING count(*) > 6),
w AS (SELECT id, unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]{{3,}}')) AS word FROM src),
m(c, name) AS (VALUES {_MARKS}),
h AS (SELECT id, name, len(regexp_extract_all(text, '[' || c || ']')) AS n, length(string_split_regex(text, '[' || c || ']')[1]) AS k FROM src, m WHERE regexp_matches(text, '[' || c || ']')),
f0 AS (SELECT id, 'instructions' AS detector, CASE WHEN len(s) > 0 OR len(n) > 1 THEN 'high' ELSE 'medium' END AS severity, CASE WHEN len(s) > 0 THEN 0.9 WHEN len(n) > 1 THEN 0.8 ELSE 0.55 END::DOUBLE AS confidence,
    {_AROUND("coalesce(list_min(s), list_min(n))", AFTER_INSTRUCTION)} AS excerpt FROM i WHERE len(s) > 0 OR len(n) > 0
UNION ALL SELECT id, 'role_tokens', 'high', 0.95, {_AROUND(_PLACES(ROLE_TOKENS) + "[1]", AFTER_ROLE)} FROM src WHERE regexp_matches(text, '{_re2(_ANY(ROLE_TOKENS))}', 'im')
UNION ALL SELECT id, 'hidden_characters', 'medium', 0.7, 'invisible characters present: ' || string_agg(name || ' (' || n || ')', ', ' ORDER BY n DESC, k) FROM h GROUP BY id
UNION ALL SELECT id, 'mixed_scripts', 'medium', 0.75, 'mixed-script words: ' || array_to_string(list_sort(list(DISTINCT word))[1:8], ', ') FROM w WHERE regexp_matches(word, '\\p{{Latin}}') AND regexp_matches(word, '\\p{{Cyrillic}}|\\p{{Greek}}') GROUP BY id
UNION ALL SELECT id, 'repetition', 'low', 0.6, '"' || arg_max(phrase, (c, -k)) || '" appears ' || max(c) || ' times' FROM gc GROUP BY id),
f AS (SELECT * REPLACE ({_SHORT} AS excerpt) FROM f0)"""
#: The same on normal forms, with hidden characters from the raw texts.
_SCANNED = _FOUND.replace("src AS (SELECT doc_id AS id", "raw_src AS (SELECT doc_id AS id", 1).replace("FROM src, m WHERE", "FROM raw_src, m WHERE", 1).replace(", i AS (SELECT", f", src AS (SELECT id, {T.normalised_sql("coalesce(text, '')")} AS text FROM raw_src), i AS (SELECT", 1)
_TIER = f"""{_FOUND}, t AS (SELECT id, max(CASE WHEN severity = 'high' AND confidence >= {QUARANTINE_AT} THEN 2 WHEN severity <> 'low' THEN 1 ELSE 0 END) AS t FROM f GROUP BY id),
tier AS (SELECT id, coalesce(t, 0) AS rank FROM src LEFT JOIN t USING (id))"""

QUERIES = {
    "text_findings": (text_findings, f"WITH {_FOUND} SELECT * FROM f"),
    "integrity_tiers": (integrity_tiers, f"WITH {_TIER} SELECT id, ['clean', 'suspect', 'quarantine'][rank + 1] AS tier FROM tier"),
    "worst_tier": (worst_tier, f"WITH {_TIER} SELECT source, max(rank) AS rank, count(*) FILTER (rank > 0) AS n_flagged FROM tier JOIN documents ON id = doc_id GROUP BY source"),
    "hidden_spans": (hidden_spans, f"""WITH {fixtures.sql("sp", SPANS_SCHEMA, SPANS)}, s AS (SELECT *, round(greatest(abs(r - br), abs(g - bg), abs(b - bb)), 6) AS contrast FROM sp WHERE chars >= {LEAST_RUN}),
        k AS (SELECT span_id, 'colour' AS kind, 0.9::DOUBLE AS confidence FROM s WHERE alpha < {INVISIBLE_ALPHA} OR contrast <= {LEAST_CONTRAST} UNION ALL SELECT span_id, 'size', 0.9 FROM s WHERE font < {LEAST_FONT}
            UNION ALL SELECT span_id, 'off_page', 0.85 FROM s WHERE x1 < vx0 OR x0 > vx1 OR y1 < vy0 OR y0 > vy1 OR behind) SELECT span_id, kind, 'high' AS severity, confidence FROM k"""),
    "metadata_findings": (metadata_findings, f"""WITH {fixtures.TEXTS_SQL}, m AS (SELECT 'literal' AS "of", fx_id AS id, 'subject' AS field, text AS value FROM fx UNION ALL SELECT 'literal', fx_id, 'comments', reverse(text) FROM fx
            {" ".join(f"UNION ALL SELECT 'page', page_id, '{f}', regexp_extract(coalesce(html, ''), '{p}', 1) FROM pages" for f, p in PAGE_FIELDS.items())}),
        x AS (SELECT "of", id, field, field || ': ' || value AS excerpt FROM m WHERE value <> '' AND regexp_matches(value, '{_re2(_ANY((*SYSTEM, *IMPERATIVES)))}', 'im'))
        SELECT "of", id, field, 'high' AS severity, 0.9::DOUBLE AS confidence, {_SHORT} AS excerpt FROM x"""),
    "render_difference": (render_difference, r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        s AS (SELECT page_id, regexp_replace(html, '<[^>]*>', ' ', 'g') AS raw, list_distinct(regexp_extract_all(lower(regexp_replace(regexp_replace(html,
            '<script.*?</script>|<style.*?</style>|<nav.*?</nav>|<!--.*?-->', ' ', 'gs'), '<[^>]*>', ' ', 'g')), '[a-z0-9]+')) AS seen FROM p),
        p2 AS (SELECT page_id, seen, string_split_regex(regexp_replace(raw, '([.!?])\s+', '\1' || chr(10), 'g'), '\n+') AS parts FROM s WHERE len(seen) > 0),
        x AS (SELECT page_id, seen, unnest(range(len(parts))) AS place, regexp_replace(unnest(parts), '^\s+|\s+$', '', 'g') AS s FROM p2), w AS (SELECT *, regexp_extract_all(lower(s), '[a-z0-9]+') AS w FROM x)
        SELECT page_id, count(*) AS n_sentences, (sum(length(s) + 1) - 1)::BIGINT AS n_chars/*more*/ FROM w WHERE len(w) >= 4 AND len(list_filter(w, lambda x: list_contains(seen, x))) < 0.6 * len(w) GROUP BY page_id HAVING sum(length(s) + 1) - 1 >= 60"""),
    "document_scans": (document_scans, f"""WITH md AS ({{metadata}}), rd AS ({{render}}), ft AS (WITH {_SCANNED} SELECT id, detector, severity, confidence, excerpt FROM f), so AS (WITH {SOURCES} SELECT id FROM src)
        SELECT 'text' AS "of", id, detector, severity, confidence, excerpt, NULL::VARCHAR AS skipped FROM ft UNION ALL SELECT 'text', id, 'render_difference', NULL, NULL, NULL, '{NO_PAGES}' FROM so
        UNION ALL SELECT "of", id, 'metadata', severity, confidence, excerpt, NULL FROM md UNION ALL SELECT 'page', page_id, 'render_difference', 'high', 0.82, {_SHORT}, NULL FROM (SELECT page_id, 'page 1: ' || missing AS excerpt FROM rd)"""),
}
QUERIES["document_scans"] = (document_scans, QUERIES["document_scans"][1].replace("{metadata}", QUERIES["metadata_findings"][1]).replace("{render}", QUERIES["render_difference"][1].replace("/*more*/", ", string_agg(s, ' ' ORDER BY place) AS missing")))
