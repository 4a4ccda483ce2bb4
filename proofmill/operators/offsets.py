"""Offset maps: the normal form of a text with where each of its characters came from, and places carried both ways.

A map is a list of runs (norm_start, raw_start, length) that tile the normal form; in a run both texts advance together.
Places are carried by a range join: runs and places are dealt by text and by bins of ``BIN`` characters, so a long text's
map is spread over tasks and no place is compared with all runs of its text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofmill import fixtures
from proofmill.functions import text as T
from proofmill.operators.integrity import SOURCES, sources

#: Characters of a bin, and of a page: pages of a fixed size stand for printed ones.
BIN, PAGE_CHARS = 1024, 3000
#: Bytes of texts that a task holds with their maps at a time.
SLICE_BYTES = 1 << 20
OUT_OF_RANGE = "OFFSET_OUT_OF_RANGE"
#: Stretches of characters that no rule before the last two changes, and single other characters.
_STRETCHES = re.compile("[\\x00-\\x7FÀ-ÅÇ-åç-ÿ]+|[\\s\\S]")
_LINE_END, _WHITE = re.compile(r"-[ \t]*\n[ \t]*(?=(\w))"), re.compile(r"\s{2,}|[^\S ]")
_MAP = "raw string, text string, runs array<struct<norm_start:int,raw_start:int,length:int>>"


def character_form(c: str) -> str:
    """What stands for one character: its compatibility form, with ligatures, dashes and quotes as ASCII and nothing invisible."""
    out = "".join(T.LIGATURES.get(d, d) for d in unicodedata.normalize("NFKC", c))
    plain = ("-" if d in T.DASHES else "'" if d in T.SINGLE_QUOTES else '"' if d in T.DOUBLE_QUOTES else d for d in out)
    return "".join(d for d in plain if d not in T.INVISIBLE)


def _without(text: str, places: np.ndarray, gaps: list[tuple[int, int, str]]) -> tuple[str, np.ndarray]:
    """``text`` and ``places`` with each gap (start, stop, what stays) cut; what stays has the place of the gap's start."""
    parts, kept, at = [], [], 0
    for start, stop, stays in gaps:
        parts += [text[at:start], stays]
        kept += [places[at:start], places[start : start + len(stays)]]
        at = stop
    return "".join([*parts, text[at:]]), np.concatenate([*kept, places[at:]])


def normal_form(text: str) -> tuple[str, np.ndarray]:
    """The normal form of a text, and the place that each of its characters has in the text."""
    parts, places = [], []
    for m in _STRETCHES.finditer(text):
        part = m.group() if len(m.group()) > 1 or m.group() < "\x80" else character_form(m.group())
        parts.append(part)
        places.append(np.arange(*m.span()) if len(part) == m.end() - m.start() else np.full(len(part), m.start()))
    mapped, at = "".join(parts), np.concatenate(places) if places else np.empty(0, np.int64)
    # A hyphen at the end of a line goes, with the break, if a lower-case letter follows.
    mapped, at = _without(mapped, at, [(*m.span(), "") for m in _LINE_END.finditer(mapped) if m.group(1).islower()])
    mapped, at = _without(mapped, at, [(*m.span(), " ") for m in _WHITE.finditer(mapped)])
    lead = mapped[:1] == " "
    return mapped.strip(" "), at[lead : len(mapped) - (len(mapped) > 1 and mapped[-1] == " ") if mapped != " " else 0]


@F.pandas_udf(StringType())
def normal_text(texts: pd.Series) -> pd.Series:
    """The normal form alone, for a quotation whose own places nobody asks for; null stays null."""
    return texts.map(lambda t: None if t is None else normal_form(t)[0])


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of batches whose texts have about ``SLICE_BYTES`` bytes, unless one text is longer; memory then grows with neither rows nor their length."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)) if batch.num_rows else np.empty(0, np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes, dtype=np.int64) // SLICE_BYTES)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def normalise_with_map(texts: DataFrame) -> DataFrame:
    """(id, raw, text, runs) of rows (id, text): the normal form and its map; a null text is empty.

    Spark has no Unicode normal forms, so this runs in Arrow batches; each call of the helper is one text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw = [t or "" for t in batch.column("text").to_pylist()]
            texts, rows, ends = [], [], [0]
            for text, places in map(normal_form, raw):
                starts = np.concatenate(([0], np.flatnonzero(np.diff(places) != 1) + 1)) if len(places) else np.empty(0, np.int64)
                rows.append(np.stack([starts, places[starts], np.diff(np.concatenate((starts, [len(places)])))]).astype(np.int32) if len(places) else np.empty((3, 0), np.int32))
                texts.append(text)
                ends.append(ends[-1] + len(starts))
            every = np.concatenate(rows, axis=1) if rows else np.empty((3, 0), np.int32)
            runs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(r) for r in every], ["norm_start", "raw_start", "length"]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(raw, pa.string()), pa.array(texts, pa.string()), runs], ["id", "raw", "text", "runs"])

    return texts.select("id", "text").mapInArrow(run, f"id bigint, {_MAP}")


# -- range joins


def binned(intervals: DataFrame) -> DataFrame:
    """A row of (id, lo, hi, ...) for each bin that the interval touches; empty intervals touch none."""
    some = intervals.where(F.col("lo") < F.col("hi"))
    return some.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / BIN), F.floor((F.col("hi") - 1) / BIN))))


def held_by(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` (id, at, ...) with the columns of the interval (id, lo, hi, ...) that holds each, or nulls; intervals of an id must be disjoint."""
    rows = binned(intervals).withColumnsRenamed({"id": "_id", "bin": "_bin"})
    placed = points.withColumn("_at_bin", F.floor(F.col("at") / BIN))
    there = (F.col("id") == F.col("_id")) & (F.col("_at_bin") == F.col("_bin")) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi"))
    return placed.join(rows, there, "left").drop("_id", "_bin", "_at_bin")


def runs_of(mapped: DataFrame) -> DataFrame:
    """(id, norm_start, raw_start, length, before) of a map, a row for each run; ``before`` is where the runs before it end in the raw text."""
    rows = mapped.select("id", F.explode("runs").alias("r")).select("id", "r.*")
    stop = F.col("raw_start") + F.col("length")
    return rows.withColumn("before", F.coalesce(F.lag(stop).over(Window.partitionBy("id").orderBy("norm_start")), F.lit(0)))


def carried(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points`` (id, at, total, ...) with ``norm``: the first character of the normal form that comes from the raw place ``at`` or a later one.

    A run also holds the gap before it; behind the last run the place is the ``total`` of the text's normal form.
    """
    own = runs.select("id", F.col("before").alias("lo"), (F.col("raw_start") + F.col("length")).alias("hi"), "raw_start", "norm_start")
    found = held_by(points, own)
    norm = F.coalesce(F.col("norm_start") + F.greatest(F.col("at") - F.col("raw_start"), F.lit(0)), F.col("total"))
    return found.select(*points.columns, norm.cast("bigint").alias("norm"))


def to_raw(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points`` (id, at, ...) of the normal form with ``raw``; null outside the map, never the nearest place."""
    own = runs.select("id", F.col("norm_start").alias("lo"), (F.col("norm_start") + F.col("length")).alias("hi"), F.col("raw_start").alias("_from"))
    return held_by(points, own).select(*points.columns, (F.col("_from") + F.col("at") - F.col("lo")).cast("bigint").alias("raw"))


def to_norm(points: DataFrame, runs: DataFrame) -> DataFrame:
    """``points`` (id, at, ...) of the raw text with ``norm``; null for a character that was removed. Of several that came from one the first counts."""
    own = runs.select("id", F.greatest("before", "raw_start").alias("lo"), (F.col("raw_start") + F.col("length")).alias("hi"), F.col("raw_start").alias("_from"), F.col("norm_start").alias("_to"))
    return held_by(points, own).select(*points.columns, (F.col("_to") + F.col("at") - F.col("_from")).cast("bigint").alias("norm"))


def raw_spans(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """``spans`` (id, start, stop, ...) of the normal form with raw_start, raw_stop and ``error``, which is null where both are known.

    The end is that of the last character, so a span that ends at collapsed white space takes no word after it.
    """
    keys = spans.columns
    first = to_raw(spans.withColumn("at", F.col("start")), runs).withColumnRenamed("raw", "raw_start").drop("at")
    both = to_raw(first.withColumn("at", F.col("stop") - 1), runs).withColumn("raw_stop", F.col("raw") + 1)
    wrong = F.col("raw_start").isNull() | F.col("raw_stop").isNull() | (F.col("start") >= F.col("stop"))
    clean = lambda c: F.when(~wrong, F.col(c)).alias(c)
    return both.select(*keys, clean("raw_start"), clean("raw_stop"), F.when(wrong, OUT_OF_RANGE).alias("error"))


# -- pages and blocks


def raw_bounds(mapped: DataFrame) -> DataFrame:
    """(id, total, kind, nth, start, stop) in the raw text: pages of ``PAGE_CHARS`` characters, and lines as blocks, numbered from 0."""
    rows = mapped.where(F.length("raw") > 0).select("id", "raw", F.length("text").alias("total"))
    starts = F.sequence(F.lit(0), F.length("raw") - 1, F.lit(PAGE_CHARS))
    pages = rows.select("id", "total", F.lit("page").alias("kind"), F.posexplode(starts).alias("nth", "start"), F.length("raw").alias("n"))
    pages = pages.select("id", "total", "kind", "nth", "start", F.least(F.col("start") + PAGE_CHARS, F.col("n")).alias("stop"))
    lines = rows.select("id", "total", F.lit("block").alias("kind"), F.posexplode(F.split("raw", "\n", -1)).alias("nth", "line"))
    stop = F.sum(F.length("line") + 1).over(Window.partitionBy("id").orderBy("nth")) - 1
    return pages.unionAll(lines.select("id", "total", "kind", "nth", (stop - F.length("line")).alias("start"), stop.alias("stop")))


def carried_bounds(mapped: DataFrame) -> DataFrame:
    """(id, kind, nth, start, stop) in the normal form: pages tile it, each up to the next one; blocks that nothing is left of are gone."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.col("start").alias("at")), F.struct(F.lit(1).alias("end"), F.col("stop").alias("at"))))
    points = raw_bounds(mapped).select("id", "total", "kind", "nth", ends.alias("e")).select("id", "total", "kind", "nth", "e.end", "e.at")
    placed = carried(points, runs_of(mapped)).groupBy("id", "kind", "nth").agg(
        F.min(F.when(F.col("end") == 0, F.col("norm"))).alias("start"), F.min(F.when(F.col("end") == 1, F.col("norm"))).alias("stop"), F.max("total").alias("total")
    )
    after = F.coalesce(F.lead("start").over(Window.partitionBy("id", "kind").orderBy("nth")), F.col("total"))
    tiled = placed.withColumn("stop", F.when(F.col("kind") == "page", after).otherwise(F.col("stop")).cast("bigint"))
    return tiled.where((F.col("kind") == "page") | (F.col("start") < F.col("stop"))).select("id", "kind", F.col("nth").cast("bigint").alias("nth"), "start", "stop")


def normal_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and blocks of every text in its normal form."""
    return carried_bounds(normalise_with_map(sources(spark, sf_dir)))


def translated_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block of the normal form back in the raw text, and where the line end behind it went, which is nowhere unless it is now a blank."""
    mapped = normalise_with_map(sources(spark, sf_dir))
    runs = runs_of(mapped)
    spans = raw_spans(carried_bounds(mapped).where(F.col("kind") == "block").select("id", "nth", "start", "stop"), runs)
    ends = raw_bounds(mapped).where(F.col("kind") == "block").select(F.col("id").alias("of"), F.col("nth").cast("bigint").alias("line"), F.col("stop").alias("end"))
    joined = spans.join(ends, (F.col("id") == F.col("of")) & (F.col("nth") == F.col("line"))).withColumnRenamed("end", "at")
    return to_norm(joined, runs).select("id", "nth", "start", "stop", "raw_start", "raw_stop", "error", F.col("norm").alias("end_norm"))


def mapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each text's normal form and map, and the raw place of its middle character."""
    mapped = normalise_with_map(sources(spark, sf_dir))
    points = mapped.select("id", F.length("text").alias("n_chars"), F.size("runs").alias("n_runs"), F.floor(F.length("text") / 2).alias("at"))
    return to_raw(points, runs_of(mapped)).select("id", "n_chars", "n_runs", F.col("raw").alias("raw_middle"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Characters that a rule may change: those of the rules, and those of the literal rows; other tables have none.
_CHANGED = sorted(c for c in {*T.LIGATURES, *T.DASHES, *T.SINGLE_QUOTES, *T.DOUBLE_QUOTES, *T.INVISIBLE, *"".join(t for _, t in fixtures.TEXTS)} if character_form(c) != c)
#: The map character by character, in SQL of its own: o(id, raw, norm, c) of src(id, text).
CHARACTERS = f"""sub(ch, rep) AS (VALUES {", ".join(f"({_quoted(c)}, {_quoted(character_form(c))})" for c in _CHANGED)}),
c0 AS (SELECT id, unnest(range(length(text))) AS raw, unnest(regexp_extract_all(text, '(?s).')) AS c FROM src WHERE text <> ''),
c1 AS (SELECT id, raw, coalesce(rep, c) AS s FROM c0 LEFT JOIN sub ON c = ch),
c2 AS (SELECT id, raw, unnest(range(length(s))) AS k, unnest(regexp_extract_all(s, '(?s).')) AS c FROM c1 WHERE s <> ''),
c3 AS (SELECT id, raw, c, row_number() OVER (PARTITION BY id ORDER BY raw, k) AS p FROM c2),
c4 AS (SELECT *, min(CASE WHEN c NOT IN (' ', chr(9)) THEN p END) OVER (PARTITION BY id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM c3),
hy AS (SELECT a.id, a.p AS lo, b.nx AS hi FROM c4 a JOIN c4 b ON a.id = b.id AND a.nx = b.p JOIN c4 d ON d.id = b.id AND d.p = b.nx WHERE a.c = '-' AND b.c = chr(10) AND regexp_full_match(d.c, '\\p{{Ll}}')),
c5 AS (SELECT c4.id, raw, p, c, regexp_full_match(c, '{T._WHITE}') AS w FROM c4 LEFT JOIN hy ON c4.id = hy.id AND p >= lo AND p < hi WHERE hy.id IS NULL),
c6 AS (SELECT *, lag(w) OVER (PARTITION BY id ORDER BY p) AS before, max(CASE WHEN NOT w THEN p END) OVER (PARTITION BY id) AS last FROM c5),
o AS (SELECT id, raw, row_number() OVER (PARTITION BY id ORDER BY p) - 1 AS norm, CASE WHEN w THEN ' ' ELSE c END AS c FROM c6 WHERE NOT w OR (NOT coalesce(before, true) AND p < last))"""
#: Pages and blocks: nb(id, kind, nth, start, stop) in the normal form, from the numbers of characters kept before a raw place.
BOUNDS = f"""le AS (SELECT id, raw AS pos FROM c0 WHERE c = chr(10) UNION ALL SELECT id, length(text) FROM src WHERE text <> ''),
rb AS (SELECT id, 'block' AS kind, row_number() OVER w - 1 AS nth, coalesce(lag(pos) OVER w + 1, 0) AS start, pos AS stop FROM le WINDOW w AS (PARTITION BY id ORDER BY pos)
    UNION ALL SELECT id, 'page', k, k * {PAGE_CHARS}, NULL FROM src, range((length(text) + {PAGE_CHARS - 1}) // {PAGE_CHARS}) AS r(k) WHERE text <> ''),
pt AS (SELECT id, kind, nth, 0 AS e, start AS pos FROM rb UNION ALL SELECT id, kind, nth, 1, stop FROM rb WHERE kind = 'block'),
un AS (SELECT id, pos, 0 AS s, kind, nth, e FROM pt UNION ALL SELECT id, raw, 1, NULL, NULL, NULL FROM o),
kn AS (SELECT *, coalesce(sum(s) OVER (PARTITION BY id ORDER BY pos, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS norm, sum(s) OVER (PARTITION BY id) AS total FROM un),
nc AS (SELECT id, kind, nth, min(norm) FILTER (e = 0) AS start, min(norm) FILTER (e = 1) AS stop, max(total) AS total FROM kn WHERE kind IS NOT NULL GROUP BY ALL),
nb AS (SELECT id, kind, nth, start::BIGINT AS start, CASE WHEN kind = 'page' THEN coalesce(lead(start) OVER (PARTITION BY id, kind ORDER BY nth), total) ELSE stop END::BIGINT AS stop FROM nc QUALIFY kind = 'page' OR start < stop)"""

QUERIES = {
    "mapped_texts": (mapped_texts, f"""WITH {SOURCES}, {CHARACTERS}, g AS (SELECT id, raw, norm, raw - lag(raw) OVER (PARTITION BY id ORDER BY norm) AS step FROM o),
        n AS (SELECT id, count(*) AS n_chars, count(*) FILTER (step IS NULL OR step <> 1) AS n_runs FROM g GROUP BY id)
        SELECT src.id, coalesce(n_chars, 0) AS n_chars, coalesce(n_runs, 0) AS n_runs, o.raw AS raw_middle FROM src LEFT JOIN n ON n.id = src.id LEFT JOIN o ON o.id = src.id AND norm = n_chars // 2"""),
    "normal_bounds": (normal_bounds, f"WITH {SOURCES}, {CHARACTERS}, {BOUNDS} SELECT id, kind, nth, start, stop FROM nb"),
    "translated_blocks": (translated_blocks, f"""WITH {SOURCES}, {CHARACTERS}, {BOUNDS}, f AS (SELECT id, raw, min(norm) AS norm FROM o GROUP BY ALL),
        xa AS MATERIALIZED (SELECT nb.*, o.raw::BIGINT AS raw_start FROM nb JOIN o ON o.id = nb.id AND o.norm = nb.start WHERE kind = 'block'),
        xb AS MATERIALIZED (SELECT xa.*, (o.raw + 1)::BIGINT AS raw_stop FROM xa JOIN o ON o.id = xa.id AND o.norm = xa.stop - 1),
        xc AS MATERIALIZED (SELECT xb.*, rb.stop AS line_end FROM xb JOIN rb ON rb.id = xb.id AND rb.kind = 'block' AND rb.nth = xb.nth)
        SELECT xc.id, nth, start, stop, raw_start, raw_stop, NULL::VARCHAR AS error, f.norm AS end_norm FROM xc LEFT JOIN f ON f.id = xc.id AND f.raw = line_end"""),
}
