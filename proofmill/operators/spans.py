"""Quotations held against their sources, in one coordinate system: that of the normal form on both sides.

Quotation and document are normalised before every step. Pages and blocks come from the raw text through the offset map, by
range joins, and a placed quotation goes back to the raw text the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.functions import text as T
from proofmill.operators import offsets
from proofmill.tables import read_table, spread

TOLERANCE, RADIUS, THRESHOLD, OCR_THRESHOLD = 400, 1500, 0.92, 0.90
SPAN_CHARS, QUOTED_FROM, DISPLACED = 60, 20, 700
#: Bounds of a quotation's length in a piece of evidence.
SHORTEST, LONGEST = 8, 600
#: Verdicts that accept a quotation; absence of evidence has nothing to place and is accepted too.
VALID, ABSENT = ("exact", "relocated", "fuzzy", "fuzzy_ocr"), "not_applicable"
CONTEXT_CHARS = 240
#: Tasks for each core by which quotations are dealt for the fuzzy step.
TASKS_A_CORE = 8


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(claim_id, cited, span, claimed, claimed_stop): a quotation of every document, of one of eight kinds by its id.

    Right; displaced; with a wrong character; reversed; of another document; in another typography (curly quotes, long dashes, doubled
    blanks, something invisible); raw text over the first line break; and none at all. Places are of the normal form.
    """
    docs = spread(read_table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    kind, normal = F.pmod("doc_id", F.lit(8)), T.normalised(F.col("text"))
    rows = docs.select("doc_id", kind.alias("kind"), "text", F.substring(normal, QUOTED_FROM + 1, SPAN_CHARS).alias("quote"))
    c = F.col
    misread = F.concat(F.substring("quote", 1, 30), F.lit("#"), F.substring("quote", 32, SPAN_CHARS))
    typography = F.concat(F.lit("​"), F.replace(F.translate("quote", "-'\"", "–’“"), F.lit(" "), F.lit("  ")))
    raw = F.substring("text", F.greatest(F.position(F.lit("\n"), c("text")) - 30, F.lit(1)), F.lit(SPAN_CHARS))
    span = F.when(c("kind") == 2, misread).when(c("kind") == 3, F.reverse("quote")).when(c("kind") == 5, typography).when(c("kind") == 6, raw).when(c("kind") == 7, None).otherwise(c("quote"))
    claimed = F.when(c("kind") == 1, DISPLACED).otherwise(QUOTED_FROM)
    return rows.select(
        c("doc_id").alias("claim_id"), F.when(c("kind") == 4, c("doc_id") + 10**9).otherwise(c("doc_id")).alias("cited"), span.alias("span"),
        claimed.alias("claimed"), (claimed + F.coalesce(F.length(span), F.lit(0))).alias("claimed_stop"),
    )


def page_method(doc: Column, page: Column) -> Column:
    """How a page was read; the tables have no scans, so every other page of each third document stands for one."""
    return F.when((doc % 3 == 0) & (page % 2 == 0), "ocr").otherwise("digital")


def _nearest(text: Column, needle: Column, claimed: Column) -> tuple[Column, Column]:
    """How often ``needle`` stands in ``text``, overlapping occurrences too, and the place nearest to ``claimed``, the earlier of two.

    A text splits before each occurrence; the parts' lengths add up to the places.
    """
    quoted = F.regexp_replace(needle, r"([^\p{L}\p{N}\s])", r"\\$1")
    parts = F.transform(F.split(text, F.concat(F.lit("(?="), quoted, F.lit(")")), -1), F.length)
    rest = F.slice(parts, F.lit(1), F.size(parts) - 1)
    # An occurrence at the very start has no part before it.
    steps = F.when(F.startswith(text, needle), F.concat(F.array(F.lit(0)), rest)).otherwise(rest)

    def add(acc: Column, gap: Column) -> Column:
        at = acc["at"] + gap
        nearer = acc["best"].isNull() | (F.abs(at - claimed) < F.abs(acc["best"] - claimed))
        return F.struct(at.alias("at"), F.when(nearer, at).otherwise(acc["best"]).alias("best"), (acc["n"] + 1).alias("n"))

    first = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("best"), F.lit(0).alias("n"))
    found = F.aggregate(steps, first, add)
    return found["n"], found["best"]


def placed_spans(claims: DataFrame, mapped: DataFrame, bounds: DataFrame) -> DataFrame:
    """G7 up to the fuzzy step: (claim_id, cited, span, needle, text, claimed, claimed_stop, method, verdict, place) of each claim.

    ``mapped`` has the documents' normal forms, ``bounds`` their pages. ``text`` is there only where ``verdict`` is "unplaced",
    for the fuzzy step. Outside all pages the method is that of the first one.
    """
    pages = bounds.where(F.col("kind") == "page").select("id", F.col("start").alias("lo"), F.col("stop").alias("hi"), F.col("nth").alias("page"))
    points = claims.withColumns({"id": F.col("cited"), "at": F.col("claimed"), "needle": offsets.normal_text(F.col("span"))})
    paged = offsets.held_by(points, pages).withColumn("method", page_method(F.col("cited"), F.coalesce("page", F.lit(0)))).drop("id", "at", "lo", "hi", "page")
    joined = paged.join(mapped.select(F.col("id").alias("_id"), "text"), F.col("cited") == F.col("_id"), "left").drop("_id")
    c = F.col
    exact = F.substring("text", c("claimed") + 1, F.length("needle")) == c("needle")
    early = F.when(c("span").isNull() | (c("span") == ""), ABSENT).when(c("text").isNull(), "wrong_document").when(c("needle") == "", "not_found").when(exact, "exact")
    n, nearest = _nearest(c("text"), c("needle"), c("claimed"))
    sought = early.isNull() & F.contains("text", c("needle"))
    rows = joined.withColumn("early", early).withColumn("found", F.when(sought, F.struct(n.alias("n"), nearest.alias("best"))))
    near = (c("found.n") == 1) | (F.abs(c("found.best") - c("claimed")) <= TOLERANCE)
    verdict = F.coalesce("early", F.when(c("found").isNull(), "unplaced").when(near, "relocated").otherwise("offset_mismatch"))
    place = F.when(verdict == "exact", c("claimed")).when(verdict == "relocated", c("found.best"))
    return rows.select("claim_id", "cited", "span", "needle", F.when(verdict == "unplaced", c("text")).alias("text"), "claimed", "claimed_stop", "method", verdict.alias("verdict"), place.cast("bigint").alias("place"))


def with_crossing(placed: DataFrame, bounds: DataFrame) -> DataFrame:
    """``crosses``: a quotation runs past the block that it starts in. Where it has no place of its own the claimed one counts."""
    blocks = bounds.where(F.col("kind") == "block").select("id", F.col("start").alias("lo"), F.col("stop").alias("hi"))
    moved = F.col("verdict") == "relocated"
    start = F.when(moved, F.col("place")).otherwise(F.col("claimed"))
    stop = F.when(moved, F.col("place") + F.length("needle")).otherwise(F.col("claimed_stop"))
    found = offsets.held_by(placed.withColumns({"id": F.col("cited"), "at": start, "_stop": stop}), blocks)
    judged = ~F.col("verdict").isin(ABSENT, "wrong_document") & (F.length("needle") > 0)
    return found.select(*placed.columns, F.coalesce(judged & (F.col("_stop") > F.col("hi")), F.lit(False)).alias("crosses"))


# -- the fuzzy step


def window_bounds(needle: str, text: str) -> tuple[range, list[float]]:
    """Starts of the windows of the needle's length, a quarter of it apart, and for each the most that its ratio can be.

    No alignment matches more characters than the two strings have in common, so counting them bounds the ratio.
    """
    import numpy as np

    starts = range(0, len(text) - len(needle) + 1, max(1, len(needle) // 4))
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    common = np.zeros(len(starts), dtype=np.int64)
    for letter in set(needle):
        upto = np.concatenate(([0], np.cumsum(points == ord(letter))))
        common += np.minimum(upto[np.array(starts) + len(needle)] - upto[np.array(starts)], needle.count(letter))
    return starts, (common / len(needle)).tolist()


def matched_characters(a: str, b: str) -> int:
    """The characters in the matching blocks of Ratcliff and Obershelp: the longest common part, of equals the first in ``a``, then in ``b``, and so on to its left and right.

    Parts are sought by the searches of strings, which on short ones take a fraction of the time of difflib's tables.
    """
    total, rest = 0, [(a, b)]
    while rest:
        a, b = rest.pop()
        at = size = k = 0
        while k + size < len(a):
            if a[k : k + size + 1] in b:
                at, size = k, size + 1
                while k + size < len(a) and a[k : k + size + 1] in b:
                    size += 1
            k += 1
        if size:
            j = b.find(a[at : at + size])
            total += size
            rest += [(x, y) for x, y in ((a[:at], b[:j]), (a[at + size :], b[j + size :])) if x and y]
    return total


def ratio_of(a: str, b: str) -> float:
    """difflib's ratio; from 200 characters on difflib leaves frequent ones out, so there it counts itself."""
    if len(b) >= 200:
        from difflib import SequenceMatcher

        return SequenceMatcher(None, a, b).ratio()
    return 2.0 * matched_characters(a, b) / (len(a) + len(b))


def best_ratio(needle: str, text: str, least: float = 0.0, known: dict[str, float] | None = None) -> float:
    """The best Ratcliff-Obershelp ratio of the needle with a window of the text; 0 where none reaches ``least``.

    Windows are tried in the order of their bounds, so the first one whose bound is no better ends the search. ``known`` has ratios of
    windows that another search of the same needle found, and gets those of this one.
    """
    if not needle or not text:
        return 0.0
    if len(needle) >= len(text):
        whole = ratio_of(needle, text)
        return whole if whole >= least else 0.0
    known = {} if known is None else known
    starts, bounds = window_bounds(needle, text)
    best = 0.0
    for bound, at in sorted(zip(bounds, starts), key=lambda x: (-x[0], x[1])):
        if bound < least or bound <= best:
            break
        window = text[at : at + len(needle)]
        if window not in known:
            known[window] = ratio_of(needle, window)
        best = max(best, known[window])
    return best if best >= least else 0.0


def with_ratios(placed: DataFrame, least: float = 0.0) -> DataFrame:
    """``placed`` with ``ratio``: 1 for a quotation that stands word for word, 0 for none to compare, null for a doubtful place.

    The residue is compared near the claimed place first, then in the whole text; pages that were read by OCR in the folded form,
    whose threshold is lower. Ratios under ``least`` are given as 0, which spares most comparisons. Texts fold in the JVM, and
    only rows of the residue carry one; a fold of a part of the text is a part of its fold only on average.
    """
    reach = F.greatest(2 * F.length("needle"), F.lit(RADIUS))
    near = F.substring("text", F.greatest(F.col("claimed") - reach, F.lit(0)) + 1, F.least(F.col("claimed"), reach) + reach)
    form = lambda c: F.when(F.col("method") == "ocr", T.folded(c)).otherwise(c)
    enough = F.when(F.col("method") == "ocr", OCR_THRESHOLD).otherwise(THRESHOLD)
    keys = [c for c in placed.columns if c != "text"]
    rows = placed.select(*keys, form(F.col("needle")).alias("_needle"), form(near).alias("_near"), form(F.col("text")).alias("_text"), enough.alias("_enough"))
    known = {"exact": 1.0, "relocated": 1.0, "wrong_document": 0.0, "not_found": 0.0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for verdict, needle, near, text, enough in zip(*(batch[c] for c in ("verdict", "_needle", "_near", "_text", "_enough"))):
                ratio = known.get(verdict)
                if verdict == "unplaced":
                    found: dict[str, float] = {}
                    ratio = best_ratio(needle, near, least, found)
                    ratio = ratio if ratio >= enough or near == text else max(ratio, best_ratio(needle, text, least, found))
                out.append(ratio)
            yield batch[keys].assign(ratio=pd.Series(out, index=batch.index, dtype="float64"))

    schema = placed.select(*keys).schema.add("ratio", "double")
    # Comparing costs far more than its bytes suggest: without a stated number of tasks small shuffled parts are put together, and few cores work.
    dealt = rows.repartition(TASKS_A_CORE * placed.sparkSession.sparkContext.defaultParallelism, "claim_id")
    return dealt.mapInPandas(run, schema)


def verified(claims: DataFrame, docs: DataFrame, least: float = 0.0) -> DataFrame:
    """(claim_id, verdict, ratio, place, crosses, method, accepted) of each claim against ``docs`` (id, text).

    A quotation that is near enough keeps its claimed place.
    """
    mapped = offsets.normalise_with_map(docs)
    bounds = offsets.carried_bounds(mapped)
    judged = with_ratios(placed_spans(claims, mapped, bounds), least)
    ocr = (F.col("method") == "ocr") & (F.col("ratio") >= OCR_THRESHOLD)
    fuzzy = F.when(ocr, "fuzzy_ocr").when((F.col("method") != "ocr") & (F.col("ratio") >= THRESHOLD), "fuzzy").otherwise("not_found")
    judged = judged.withColumn("verdict", F.when(F.col("verdict") == "unplaced", fuzzy).otherwise(F.col("verdict")))
    judged = judged.withColumn("place", F.when(F.col("verdict").startswith("fuzzy"), F.col("claimed")).otherwise(F.col("place")))
    return with_crossing(judged, bounds).select("claim_id", "verdict", F.round("ratio", 4).alias("ratio"), "place", "crosses", "method", F.col("verdict").isin(*VALID, ABSENT).alias("accepted"))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")))


def span_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict and place of every claim without the fuzzy step, whether it crosses a block, and how its page was read."""
    mapped = offsets.normalise_with_map(_docs(spark, sf_dir))
    bounds = offsets.carried_bounds(mapped)
    placed = placed_spans(claims(spark, sf_dir), mapped, bounds).drop("text")
    return with_crossing(placed, bounds).select("claim_id", "verdict", "place", "crosses", "method")


def span_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final verdict on every claim, accepted or rejected."""
    return verified(claims(spark, sf_dir), _docs(spark, sf_dir))


def evidence_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of the claims: protected ones are dropped, those of a wrong size are invalid, the others accepted or rejected by their verdict."""
    asked = claims(spark, sf_dir)
    protected = F.coalesce(F.size(T.protected_terms(F.col("span"))) > 0, F.lit(False))
    sized = F.coalesce(F.length("span").between(SHORTEST, LONGEST), F.lit(True))
    fate = F.when(protected, "protected").when(~sized, "invalid")
    dropped = asked.where(fate.isNotNull()).select(fate.alias("fate"), F.lit(None).cast("string").alias("verdict"))
    checked = verified(asked.where(fate.isNull()), _docs(spark, sf_dir), THRESHOLD - 0.02)
    kept = checked.select(F.when(F.col("accepted"), "accepted").otherwise("rejected").alias("fate"), "verdict")
    return dropped.unionAll(kept).groupBy("fate", "verdict").agg(F.count("*").alias("n"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By method, kept misread and caught reversed quotations at thresholds from 0.70 to 1.00.

    ``chosen`` marks the threshold of least total error, the sum of both shares that go wrong, ties to the lower; none is chosen where
    neither number moves.
    """
    asked = claims(spark, sf_dir).where(F.pmod("claim_id", F.lit(8)).isin(2, 3))
    checked = verified(asked, _docs(spark, sf_dir), 0.7).select("method", F.coalesce("ratio", F.lit(0.0)).alias("ratio"), (F.pmod("claim_id", F.lit(8)) == 2).alias("real"))
    swept = checked.withColumn("t", F.explode(F.transform(F.sequence(F.lit(70), F.lit(100), F.lit(2)), lambda t: t / 100)))
    c = F.col
    counted = swept.groupBy("method", c("t").alias("threshold")).agg(
        F.count_if(c("real") & (c("ratio") >= c("t"))).alias("kept"), F.count_if("real").alias("n_real"),
        F.count_if(~c("real") & (c("ratio") < c("t"))).alias("caught"), F.count_if(~c("real")).alias("n_false"),
    )
    wrong = lambda good, n: F.when(c(n) > 0, 1 - c(good) / c(n)).otherwise(0.0)
    counted = counted.withColumn("error", wrong("kept", "n_real") + wrong("caught", "n_false"))
    # Sixteen rows of each method.
    least = counted.groupBy(c("method").alias("of")).agg(F.min(F.struct(F.round("error", 9), "threshold")).alias("m"), F.count_distinct("kept", "caught").alias("states"))
    chosen = (c("states") > 1) & (c("threshold") == c("m.threshold"))
    return counted.join(least, c("method") == c("of")).select("method", "threshold", "kept", "n_real", "caught", "n_false", F.round("error", 6).alias("error"), chosen.alias("chosen"))


def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each claim's quotation stands first in the document that it cites, with the pages that it touches and how the first was read."""
    mapped = offsets.normalise_with_map(_docs(spark, sf_dir))
    pages = offsets.carried_bounds(mapped).where(F.col("kind") == "page").select("id", F.col("start").alias("lo"), F.col("stop").alias("hi"), F.col("nth").alias("page"))
    asked = claims(spark, sf_dir).withColumn("needle", offsets.normal_text(F.col("span"))).where(F.col("needle") != "")
    start = F.position(F.col("needle"), F.col("text")).cast("bigint") - 1
    found = asked.join(mapped, F.col("cited") == F.col("id")).select("claim_id", "id", start.alias("start"), (start + F.length("needle")).alias("stop")).where(F.col("start") >= 0)
    paged = lambda rows, at, name: offsets.held_by(rows.withColumn("at", at), pages).withColumnRenamed("page", name).drop("at", "lo", "hi")
    both = paged(paged(found, F.col("start"), "first"), F.col("stop") - 1, "last")
    return both.select("claim_id", "start", (F.col("first") + 1).alias("page_start"), (F.col("last") + 1).alias("page_end"), page_method(F.col("id"), F.col("first")).alias("method"))


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each quotation of a known document in the raw text, with what stands around it.

    The validated place counts before the claimed one, and both go through the offset map; behind its end they are cut to the end of the
    last run. If the span as it was given is not there, its first place in the raw text is shown, if it has one.
    """
    docs = _docs(spark, sf_dir)
    mapped = offsets.normalise_with_map(docs)
    runs = offsets.runs_of(mapped)
    bounds = offsets.carried_bounds(mapped)
    placed = placed_spans(claims(spark, sf_dir), mapped, bounds).where(~F.col("verdict").isin(ABSENT, "wrong_document"))
    places = placed.select("claim_id", F.col("cited").alias("id"), "span", F.coalesce("place", "claimed").alias("start"), F.length("span").alias("n"))
    first = offsets.to_raw(places.withColumn("at", F.col("start")), runs).withColumnRenamed("raw", "first").drop("at")
    both = offsets.to_raw(first.withColumn("at", F.col("start") + F.col("n")), runs).withColumnRenamed("raw", "last").drop("at")
    last_run = F.element_at("runs", -1)
    ends = F.when(F.size("runs") > 0, F.least(last_run["raw_start"] + last_run["length"], F.length("raw"))).otherwise(F.length("raw"))
    texts = mapped.select(F.col("id").alias("_id"), "raw", ends.alias("end"))
    c = F.col
    shown = both.join(texts, c("id") == c("_id")).withColumns({"a": F.coalesce("first", "end"), "b": F.coalesce("last", "end")})
    # Text between two places; nothing where they are the wrong way round.
    part = lambda a, b: F.substring("raw", (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    found = F.position(c("span"), c("raw")) - 1
    missing = ~F.contains(part(c("a"), c("b")), c("span")) & (found >= 0)
    shown = shown.withColumns({"a": F.when(missing, found).otherwise(c("a")), "b": F.when(missing, found + c("n")).otherwise(c("b"))})
    quoted = part(c("a"), c("b"))
    return shown.select(
        "claim_id", part(F.greatest(c("a") - CONTEXT_CHARS, F.lit(0)), c("a")).alias("before"),
        F.when(quoted == "", c("span")).otherwise(quoted).alias("quoted"), part(c("b"), c("b") + CONTEXT_CHARS).alias("after"),
    )


_N = T.normalised_sql("text")
_CLAIMS = f"""d AS (SELECT doc_id, coalesce(text, '') AS text, {T.normalised_sql("coalesce(text, '')")} AS normal, (doc_id % 8 + 8) % 8 AS kind FROM documents),
q AS (SELECT *, normal[{QUOTED_FROM + 1}:{QUOTED_FROM + SPAN_CHARS}] AS quote FROM d),
k AS (SELECT doc_id AS claim_id, CASE WHEN kind = 4 THEN doc_id + 1000000000 ELSE doc_id END AS cited, CASE kind WHEN 2 THEN quote[1:30] || '#' || quote[32:] WHEN 3 THEN reverse(quote)
    WHEN 5 THEN chr(8203) || replace(translate(quote, '-''"', '–’“'), ' ', '  ') WHEN 6 THEN substring(text, greatest(strpos(text, chr(10)) - 30, 1), {SPAN_CHARS}) WHEN 7 THEN NULL ELSE quote END AS span,
    CASE WHEN kind = 1 THEN {DISPLACED} ELSE {QUOTED_FROM} END AS claimed FROM q),
j AS (SELECT k.*, claimed + coalesce(length(span), 0) AS claimed_stop, {T.normalised_sql("span")} AS needle, d.text AS raw, d.normal AS text FROM k LEFT JOIN d ON doc_id = cited)"""
_PLACES = f"""p AS (SELECT *, substring(text, claimed + 1, length(needle)) = needle AS exact, CASE WHEN needle <> '' AND contains(text, needle) THEN list_filter(range(0, length(text) - length(needle) + 1), lambda i: substring(text, i + 1, length(needle)) = needle) ELSE [] END AS spots FROM j),
s AS (SELECT *, list_min(list_transform(spots, lambda a: abs(a - claimed))) AS off FROM p),
v AS (SELECT *, CASE WHEN coalesce(span, '') = '' THEN '{ABSENT}' WHEN text IS NULL THEN 'wrong_document' WHEN needle = '' THEN 'not_found' WHEN exact THEN 'exact' WHEN len(spots) = 0 THEN 'unplaced'
    WHEN len(spots) = 1 OR off <= {TOLERANCE} THEN 'relocated' ELSE 'offset_mismatch' END AS verdict FROM s),
w AS (SELECT *, CASE verdict WHEN 'exact' THEN claimed WHEN 'relocated' THEN list_filter(spots, lambda a: abs(a - claimed) = off)[1] END::BIGINT AS place FROM v)"""
_DOCS = "src AS (SELECT doc_id AS id, text FROM documents)"

QUERIES = {
    "span_places": (span_places, f"""WITH {_DOCS}, {offsets.CHARACTERS}, {offsets.BOUNDS}, {_CLAIMS}, {_PLACES}, x AS (SELECT *, CASE WHEN verdict = 'relocated' THEN place ELSE claimed END AS a, CASE WHEN verdict = 'relocated' THEN place + length(needle) ELSE claimed_stop END AS z FROM w)
        SELECT claim_id, verdict, place, coalesce(verdict NOT IN ('{ABSENT}', 'wrong_document') AND needle <> '' AND z > b.stop, false) AS crosses, CASE WHEN cited % 3 = 0 AND coalesce(g.nth, 0) % 2 = 0 THEN 'ocr' ELSE 'digital' END AS method
        FROM x LEFT JOIN nb b ON b.kind = 'block' AND b.id = cited AND a >= b.start AND a < b.stop LEFT JOIN nb g ON g.kind = 'page' AND g.id = cited AND claimed >= g.start AND claimed < g.stop"""),
    "page_ranges": (page_ranges, f"""WITH {_DOCS}, {offsets.CHARACTERS}, {offsets.BOUNDS}, {_CLAIMS}, x AS (SELECT claim_id, cited, strpos(text, needle) - 1 AS a, strpos(text, needle) - 1 + length(needle) AS z FROM j WHERE needle <> '' AND contains(text, needle))
        SELECT claim_id, a::BIGINT AS start, f.nth + 1 AS page_start, l.nth + 1 AS page_end, CASE WHEN cited % 3 = 0 AND f.nth % 2 = 0 THEN 'ocr' ELSE 'digital' END AS method
        FROM x JOIN nb f ON f.kind = 'page' AND f.id = cited AND a >= f.start AND a < f.stop JOIN nb l ON l.kind = 'page' AND l.id = cited AND z - 1 >= l.start AND z - 1 < l.stop"""),
    "span_checks": (span_checks, None),
    "evidence_build": (evidence_build, None),
    "threshold_sweep": (threshold_sweep, None),
    "passages": (passages, f"""WITH {_DOCS}, {offsets.CHARACTERS}, {_CLAIMS}, {_PLACES}, y AS (SELECT *, length(span) AS n, coalesce(place, claimed) AS a FROM w WHERE verdict NOT IN ('{ABSENT}', 'wrong_document')), e AS (SELECT id, max(raw) + 1 AS stop FROM o GROUP BY id),
        f AS (SELECT y.*, coalesce(o1.raw, e.stop, length(y.raw)) AS ra, coalesce(o2.raw, e.stop, length(y.raw)) AS rz FROM y LEFT JOIN e ON e.id = cited LEFT JOIN o o1 ON o1.id = cited AND o1.norm = a LEFT JOIN o o2 ON o2.id = cited AND o2.norm = a + n),
        h AS (SELECT *, NOT contains(raw[ra + 1:rz], span) AND contains(raw, span) AS missing FROM f), i AS (SELECT claim_id, span, raw, CASE WHEN missing THEN strpos(raw, span) - 1 ELSE ra END AS ra, CASE WHEN missing THEN strpos(raw, span) - 1 + n ELSE rz END AS rz FROM h)
        SELECT claim_id, raw[greatest(ra - {CONTEXT_CHARS}, 0) + 1:ra] AS before, CASE WHEN raw[ra + 1:rz] = '' THEN span ELSE raw[ra + 1:rz] END AS quoted, raw[rz + 1:rz + {CONTEXT_CHARS}] AS after FROM i"""),
}
