"""Evaluation and fairness: every rate with its counts and interval, null where nothing was measured."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.functions.stats import share, wilson, wilson_sql
from proofmill.plans.views import EVENTS, RUNS, run_events, runs
from proofmill.tables import read_table

LADDER = ("decline", "hold", "advance")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, arm, expected, got, toxic): labelled documents; what an arm says of them follows from their length."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), "lang")
    gold = read_table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("quality") + F.col("doc_id") % 2).alias("gold"), "toxic")
    joined = gold.join(docs, "doc_id")
    got = F.least(F.floor(F.col("n") / 1200), F.lit(2)).cast("int")
    return joined.select(F.col("doc_id").alias("case_id"), F.when(F.col("doc_id") % 4 == 0, "naive").otherwise("pipeline").alias("arm"), F.col("gold").cast("int").alias("gold"), got.alias("got"), "toxic", "n", "lang")


_CASES = """cases AS (SELECT l.doc_id AS case_id, CASE WHEN l.doc_id % 4 = 0 THEN 'naive' ELSE 'pipeline' END AS arm, CASE WHEN l.doc_id % 9 <> 0 THEN quality + l.doc_id % 2 END::INT AS gold,
    least(floor(length(coalesce(text, '')) / 1200), 2)::INT AS got, toxic, length(coalesce(text, '')) AS n, lang FROM labels l JOIN documents USING (doc_id))"""


def band_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By arm the share of asserted bands that are met, or within one, with 95 % intervals."""
    asserted = F.col("gold").isNotNull()
    by_arm = cases(spark, sf_dir).groupBy("arm").agg(F.count_if(asserted).alias("n"), F.count_if(asserted & (F.col("gold") == F.col("got"))).alias("k"), F.count_if(asserted & (F.abs(F.col("gold") - F.col("got")) <= 1)).alias("k_within"))
    low, high = wilson(F.col("k"), F.col("n"))
    return by_arm.select("arm", "n", "k", "k_within", F.round(share(F.col("k"), F.col("n")), 6).alias("accuracy"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa by arm from a table of pairs; pairs with a null are left out, full chance agreement gives 1 or 0."""
    pairs = cases(spark, sf_dir).where(F.col("gold").isNotNull() & F.col("got").isNotNull()).groupBy("arm", "gold", "got").agg(F.count("*").alias("c"))
    side = lambda column: pairs.groupBy("arm", F.col(column).alias("band")).agg(F.sum("c").alias(column))
    chance = side("gold").join(side("got"), ["arm", "band"]).groupBy("arm").agg(F.sum(F.col("gold") * F.col("got")).alias("chance"))
    agreed = pairs.groupBy("arm").agg(F.sum("c").alias("n"), F.sum(F.when(F.col("gold") == F.col("got"), F.col("c")).otherwise(0)).alias("k"))
    p, e = F.col("k") / F.col("n"), F.coalesce("chance", F.lit(0)) / (F.col("n") * F.col("n"))
    value = F.when(e == 1, F.when(p == 1, 1.0).otherwise(0.0)).otherwise((p - e) / (1 - e))
    return agreed.join(chance, "arm", "left").select("arm", "n", F.round(value, 6).alias("kappa"))


def abstention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H6, H7, H9: expected states and forbidden phrases as lists, each entry a row, by arm."""
    listed = cases(spark, sf_dir).select("arm", "case_id", "got", "toxic", F.explode(F.array(F.lit("c1"), F.lit("c2"), F.lit("c3"))).alias("criterion"))
    must = (F.col("case_id") + F.length("criterion") + F.substring("criterion", 2, 1).cast("int")) % 3 == 0
    said = (F.col("got") + F.substring("criterion", 2, 1).cast("int")) % 2 == 0
    by_arm = listed.groupBy("arm").agg(F.count_if(must).alias("n"), F.count_if(must & said).alias("k"), F.count_if(said & (F.col("toxic") == 1)).alias("forbidden"))
    return by_arm.select("arm", "n", "k", "forbidden", F.round(share(F.col("k"), F.col("n")), 6).alias("rate"))


GATES_SCHEMA = "metric string, direction string, tolerance double"
GATES = [("accuracy", "up", 0.01), ("mean_chars", "down", 50.0), ("toxic_rate", "down", 0.0)]


def regression_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline arm held against the naive one, metric by metric, with direction and tolerance."""
    metrics = cases(spark, sf_dir).groupBy("arm").agg(
        F.round(F.count_if(F.col("gold") == F.col("got")) / F.count("gold"), 6).alias("accuracy"), F.round(F.sum("n") / F.count("*"), 6).alias("mean_chars"), F.round(F.sum("toxic") / F.count("*"), 6).alias("toxic_rate")
    )
    long = metrics.unpivot(["arm"], ["accuracy", "mean_chars", "toxic_rate"], "metric", "value")
    arm = lambda name, column: long.where(F.col("arm") == name).select("metric", F.col("value").alias(column))
    gates = fixtures.frame(spark, GATES_SCHEMA, GATES)
    joined = gates.join(arm("naive", "baseline"), "metric").join(arm("pipeline", "current"), "metric")
    worse = F.when(F.col("direction") == "up", F.col("baseline") - F.col("current")).otherwise(F.col("current") - F.col("baseline"))
    return joined.select("metric", "baseline", "current", (worse <= F.col("tolerance")).alias("passes"))


def changed_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases whose band is another than in the baseline, by name; "none" stands for no band, and a case that the baseline lacks is not named.

    The baseline here asserts the next band at 1100 characters instead of 1200, none for every 17th case, and lacks every 13th.
    """
    now = cases(spark, sf_dir).select("case_id", F.col("got").cast("string").alias("after"), "n")
    before = F.when(F.col("case_id") % 17 != 0, F.least(F.floor(F.col("n") / 1100), F.lit(2)).cast("string"))
    baseline = cases(spark, sf_dir).where(F.col("case_id") % 13 != 0).select("case_id", before.alias("before"))
    both = now.join(baseline, "case_id").where(~F.col("before").eqNullSafe(F.col("after")))
    named = F.format_string("%s (%s to %s)", F.col("case_id"), F.coalesce("before", F.lit("none")), F.coalesce("after", F.lit("none")))
    return both.select("case_id", named.alias("change"))


PERSONAS_SCHEMA = "persona string, name string, pronoun string, ref boolean"
PERSONAS = [("p0", "Alex Moor", "they", True), ("p1", "Maria Silva", "she", False), ("p2", "Omar Haddad", "he", False)]
TEMPLATES_SCHEMA = "base string, body string"
TEMPLATES = [("b1", "{name} led the bridge team. {pronoun} wrote the plan."), ("b2", "The report names {name} twice, {name} and {pronoun}."), ("b3", "{name} moved to {city} with {pronoun}.")]
LEFTOVER = r"\{[a-z_]+\}"


def variants(spark: SparkSession) -> DataFrame:
    """Every template for every persona, with what was left unfilled; both tables are written by people and small."""
    filled = F.replace(F.replace(F.col("body"), F.lit("{name}"), F.col("name")), F.lit("{pronoun}"), F.col("pronoun"))
    rows = fixtures.frame(spark, TEMPLATES_SCHEMA, TEMPLATES).crossJoin(F.broadcast(fixtures.frame(spark, PERSONAS_SCHEMA, PERSONAS)))
    left = F.nullif(F.regexp_extract(filled, LEFTOVER, 0), F.lit(""))
    return rows.select("base", "persona", "ref", "name", "pronoun", filled.alias("text"), left.alias("leftover"))


def refused_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants with a placeholder that no persona fills; they are refused."""
    return variants(spark).where(F.col("leftover").isNotNull()).select("base", "persona", "leftover")


def variant_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words by which a variant differs from the reference persona's beyond the identity words; none is right."""
    words = variants(spark).where(F.col("leftover").isNull()).select("base", "persona", "ref", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"), F.split(F.lower(F.concat_ws(" ", "name", "pronoun")), " ").alias("own"))
    counted = words.where((F.col("word") != "") & ~F.array_contains("own", F.col("word"))).groupBy("base", "persona", "ref", "word").agg(F.count("*").alias("n"))
    others = counted.where(~F.col("ref")).select("base", "persona", "word", "n")
    people = others.select("base", "persona").distinct()
    base = counted.where("ref").select("base", "word", F.col("n").alias("m")).join(people, "base")
    both = others.join(base, ["base", "persona", "word"], "full")
    return both.groupBy("base", "persona").agg(F.count_if(F.coalesce("n", F.lit(0)) != F.coalesce("m", F.lit(0))).alias("n_different"), F.count("*").alias("n_words"))


def _flips(rows: DataFrame, bases: int) -> DataFrame:
    """(lang, n, k, d, largest): pairs of runs of one language and base, those of different bands, the sum and the most of their distances."""
    bands = rows.groupBy("lang", (F.col("case_id") % bases).alias("base")).agg(*(F.count_if(F.col("got") == b).alias(f"b{b}") for b in range(3)))
    x, y, z = (F.col(f"b{b}") for b in range(3))
    every = x + y + z
    return bands.groupBy("lang").agg(
        F.sum((every * (every - 1) / 2).cast("bigint")).alias("n"), F.sum(x * y + y * z + x * z).alias("k"), F.sum(x * y + y * z + 2 * x * z).alias("d"), F.max(F.when(x * z > 0, 2).when(x * y + y * z > 0, 1).otherwise(0)).alias("largest")
    ).where("n > 0")


def flip_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pairs of repeated runs of a case how often the band differs, with its interval; runs of one language are repeats.

    Pairs are counted, not made: from the runs of each band, of which there are three, follow the pairs that agree and the
    distances of the others.
    """
    counted = _flips(cases(spark, sf_dir), 50)
    low, high = wilson(F.col("k"), F.col("n"))
    return counted.select("lang", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"), F.round(F.col("d") / F.col("n"), 6).alias("mean_difference"), F.col("largest").cast("int").alias("largest"))


FLOOR_LANG_BASES = 7


def flip_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's flip rate read against its floor, the rate at which repeats of one case differ; refused without a floor.

    A rate whose interval overlaps the floor's says nothing; above it is worth a look; below it the corpus is too small.
    """
    counted = lambda bases: _flips(cases(spark, sf_dir), bases)
    low, high = wilson(F.col("k"), F.col("n"))
    rates = counted(50).select("lang", "n", "k", low.alias("low"), high.alias("high"), (F.col("k") / F.col("n")).alias("rate"))
    floor = counted(FLOOR_LANG_BASES).where(F.col("lang") != "de").select("lang", low.alias("floor_low"), high.alias("floor_high"), (F.col("k") / F.col("n")).alias("floor"))
    apart = (F.col("high") < F.col("floor_low")) | (F.col("floor_high") < F.col("low"))
    reading = F.when(F.col("floor").isNull(), "refused").when(~apart, "overlaps").when(F.col("rate") > F.col("floor"), "above").otherwise("below")
    return rates.join(floor, "lang", "left").select("lang", F.round("rate", 6).alias("rate"), F.round("floor", 6).alias("floor"), reading.alias("reading"))


def naive_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the single-call arm read from raw text: fences stripped, outermost braces, JSON, and a known band.

    Events stand for answers: some are fenced, some have words around them, some are cut off or name no band.
    """
    c, band = F.col("event_id"), F.element_at(F.array(*map(F.lit, ("advance", " HOLD ", "decline", "maybe"))), (F.col("event_id") % 4 + 1).cast("int"))
    body = F.concat(F.lit('{"band": "'), band, F.lit('", "justification": "'), F.col("kind"), F.lit('"}'))
    fence = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    raw = F.when(c % 5 == 0, fence).when(c % 5 == 1, F.concat(F.lit("Answer: "), body, F.lit(" as asked."))).when(c % 5 == 2, F.substring(body, 1, 20)).when(c % 5 == 3, F.concat(F.lit("  "), body)).otherwise("no answer")
    text = F.trim(raw)
    inner = F.when(F.startswith(text, F.lit("```")), F.regexp_replace(F.split_part(text, F.lit("```"), F.lit(2)), "^json", "")).otherwise(text)
    braces = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    said = F.lower(F.trim(F.get_json_object(braces, "$.band")))
    known = F.when(said.isin(*LADDER), said)
    outcome = F.when(braces == "", "no_json").when(said.isNull(), "bad_json").when(known.isNull(), "unknown_band").otherwise("read")
    return run_events(spark, sf_dir).groupBy(outcome.alias("outcome"), known.alias("band")).agg(F.count("*").alias("n"))


#: Statuses in which a run waits for a person.
HUMAN = ("needs_review", "structured")


def human_touches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many runs of each policy wait for a person, of how many."""
    return runs(spark, sf_dir).groupBy("policy").agg(F.count_if(F.col("status").isin(*HUMAN)).alias("k"), F.count("*").alias("n"))


SETTINGS = ("arm-settings-1", "rubric-1", "prompts-1", "seed-7")


def evaluation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each case with the fingerprint of its configuration: the settings and the arm, in a fixed order."""
    mark = F.substring(F.sha2(F.concat_ws("|", *map(F.lit, SETTINGS), "arm"), 256), 1, 16)
    return cases(spark, sf_dir).select("case_id", mark.alias("configuration"), "gold", "got", (F.col("gold") == F.col("got")).alias("met"))


STATUSES = ("disabled", "empty_corpus", "no_matches", "embedding_failed", "applied")


def calibration_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each hundredth vector what came of asking for similar cases, by the first that applies of the ladder.

    No card of its label; all of them stale; a vector that says nothing; none similar enough; else applied. Every seventh query is
    switched off.
    """
    cards = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    asked = cards.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), "label", F.col("e").alias("q"))
    dot = F.aggregate(F.zip_with("e", "q", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    fresh = F.col("vec_id") % 10 != 5
    scored = cards.join(asked, "label").where(F.col("vec_id") != F.col("query_id")).groupBy("query_id").agg(F.count("*").alias("considered"), F.count_if(~fresh).alias("stale"), F.count_if(fresh & (F.round(dot, 6) >= LEAST_SIMILAR)).alias("similar"))
    c = lambda name: F.coalesce(name, F.lit(0))
    status = F.when(F.col("query_id") % 700 == 0, "disabled").when(c("considered") == 0, "empty_corpus").when(c("considered") == c("stale"), "no_matches").when(~F.exists("q", lambda x: x != 0), "embedding_failed").when(c("similar") == 0, "no_matches").otherwise("applied")
    return asked.join(scored, "query_id", "left").select("query_id", status.alias("status"), c("considered").alias("considered"), c("stale").alias("excluded_stale"))


LEAST_SIMILAR = 0.05
_LOW, _HIGH = wilson_sql("k", "n")

QUERIES = {
    "band_accuracy": (band_accuracy, f"""WITH {_CASES}, a AS (SELECT arm, count(gold) AS n, count(*) FILTER (gold = got) AS k, count(*) FILTER (abs(gold - got) <= 1) AS k_within FROM cases GROUP BY arm)
        SELECT arm, n, k, k_within, round(k / n, 6) AS accuracy, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high FROM a"""),
    "kappa": (kappa, f"""WITH {_CASES}, p AS (SELECT arm, gold, got FROM cases WHERE gold IS NOT NULL AND got IS NOT NULL), n AS (SELECT arm, count(*) AS n, count(*) FILTER (gold = got) AS k FROM p GROUP BY arm),
        g AS (SELECT arm, gold AS band, count(*) AS c FROM p GROUP BY ALL), h AS (SELECT arm, got AS band, count(*) AS c FROM p GROUP BY ALL), e AS (SELECT arm, sum(g.c * h.c) AS e FROM g JOIN h USING (arm, band) GROUP BY arm)
        SELECT arm, n, round((k / n - coalesce(e, 0) / (n * n)) / (1 - coalesce(e, 0) / (n * n)), 6) AS kappa FROM n LEFT JOIN e USING (arm)"""),
    "abstention": (abstention, f"""WITH {_CASES}, x AS (SELECT arm, (case_id + 2 + c) % 3 = 0 AS must, (got + c) % 2 = 0 AS said, toxic FROM cases, range(1, 4) AS r(c))
        SELECT arm, count(*) FILTER (must) AS n, count(*) FILTER (must AND said) AS k, count(*) FILTER (said AND toxic = 1) AS forbidden, round(count(*) FILTER (must AND said) / count(*) FILTER (must), 6) AS rate FROM x GROUP BY arm"""),
    "regression_gate": (regression_gate, f"""WITH {_CASES}, {fixtures.sql("gate", GATES_SCHEMA, GATES)}, m AS (SELECT arm, round(count(*) FILTER (gold = got) / count(gold), 6) AS accuracy, round(sum(n) / count(*), 6) AS mean_chars, round(sum(toxic) / count(*), 6) AS toxic_rate FROM cases GROUP BY arm),
        l AS (UNPIVOT m ON accuracy, mean_chars, toxic_rate INTO NAME metric VALUE value)
        SELECT metric, b.value AS baseline, c.value AS current, CASE direction WHEN 'up' THEN b.value - c.value ELSE c.value - b.value END <= tolerance AS passes FROM gate JOIN l b USING (metric) JOIN l c USING (metric) WHERE b.arm = 'naive' AND c.arm = 'pipeline'"""),
    "changed_cases": (changed_cases, f"""WITH {_CASES}, b AS (SELECT case_id, got AS after, CASE WHEN case_id % 17 <> 0 THEN least(floor(n / 1100), 2)::INT END AS before FROM cases WHERE case_id % 13 <> 0)
        SELECT case_id, case_id || ' (' || coalesce(before::VARCHAR, 'none') || ' to ' || coalesce(after::VARCHAR, 'none') || ')' AS change FROM b WHERE before IS DISTINCT FROM after"""),
    "refused_variants": (refused_variants, f"""WITH {fixtures.sql("pe", PERSONAS_SCHEMA, PERSONAS)}, {fixtures.sql("te", TEMPLATES_SCHEMA, TEMPLATES)}, v AS (SELECT base, persona, replace(replace(body, '{{name}}', name), '{{pronoun}}', pronoun) AS text FROM te, pe)
        SELECT base, persona, regexp_extract(text, '{LEFTOVER}') AS leftover FROM v WHERE regexp_matches(text, '{LEFTOVER}')"""),
    "variant_differences": (variant_differences, f"""WITH {fixtures.sql("pe", PERSONAS_SCHEMA, PERSONAS)}, {fixtures.sql("te", TEMPLATES_SCHEMA, TEMPLATES)},
        v AS (SELECT base, persona, ref, string_split(lower(name || ' ' || pronoun), ' ') AS own, unnest(string_split_regex(lower(replace(replace(body, '{{name}}', name), '{{pronoun}}', pronoun)), '[^a-z]+')) AS word FROM te, pe WHERE NOT regexp_matches(replace(replace(body, '{{name}}', name), '{{pronoun}}', pronoun), '{LEFTOVER}')),
        c AS (SELECT base, persona, ref, word, count(*) AS n FROM v WHERE word <> '' AND NOT list_contains(own, word) GROUP BY ALL), o AS (SELECT * FROM c WHERE NOT ref),
        b AS (SELECT base, p.persona, word, n AS m FROM c JOIN (SELECT DISTINCT base, persona FROM o) p USING (base) WHERE ref)
        SELECT base, persona, count(*) FILTER (coalesce(n, 0) <> coalesce(m, 0)) AS n_different, count(*) AS n_words FROM o FULL JOIN b USING (base, persona, word) GROUP BY ALL"""),
    "flip_readings": (flip_readings, f"""WITH {_CASES}, b(base_count) AS (VALUES (50), ({FLOOR_LANG_BASES})),
        p AS (SELECT base_count, x.lang, count(*) AS n, count(*) FILTER (x.got IS DISTINCT FROM y.got) AS k FROM b, cases x JOIN cases y ON x.lang = y.lang AND x.case_id < y.case_id WHERE x.case_id % base_count = y.case_id % base_count GROUP BY ALL),
        i AS (SELECT *, k / n AS rate, {_LOW} AS low, {_HIGH} AS high FROM p), r AS (FROM i WHERE base_count = 50), f AS (FROM i WHERE base_count <> 50 AND lang <> 'de')
        SELECT r.lang, round(r.rate, 6) AS rate, round(f.rate, 6) AS floor, CASE WHEN f.rate IS NULL THEN 'refused' WHEN NOT (r.high < f.low OR f.high < r.low) THEN 'overlaps' WHEN r.rate > f.rate THEN 'above' ELSE 'below' END AS reading FROM r LEFT JOIN f USING (lang)"""),
    "naive_answers": (naive_answers, f"""WITH {EVENTS}, b AS (SELECT event_id, '{{"band": "' || ['advance', ' HOLD ', 'decline', 'maybe'][event_id % 4 + 1] || '", "justification": "' || kind || '"}}' AS body FROM run_events),
        w AS (SELECT trim(CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 1 THEN 'Answer: ' || body || ' as asked.' WHEN 2 THEN substring(body, 1, 20) WHEN 3 THEN '  ' || body ELSE 'no answer' END) AS t FROM b),
        i AS (SELECT regexp_extract(CASE WHEN starts_with(t, '```') THEN regexp_replace(string_split(t, '```')[2], '^json', '') ELSE t END, '\\{{.*\\}}', 0, 's') AS j FROM w), s AS (SELECT j, CASE WHEN json_valid(j) THEN lower(trim(json_extract_string(j, '$.band'))) END AS said FROM i)
        SELECT CASE WHEN j = '' THEN 'no_json' WHEN said IS NULL THEN 'bad_json' WHEN said NOT IN {LADDER} THEN 'unknown_band' ELSE 'read' END AS outcome, CASE WHEN said IN {LADDER} THEN said END AS band, count(*) AS n FROM s GROUP BY ALL"""),
    "human_touches": (human_touches, f"WITH {RUNS} SELECT policy, count(*) FILTER (status IN {HUMAN}) AS k, count(*) AS n FROM runs GROUP BY policy"),
    "evaluation_rows": (evaluation_rows, f"WITH {_CASES} SELECT case_id, substring(sha256(concat_ws('|', '{"', '".join(SETTINGS)}', arm)), 1, 16) AS configuration, gold, got, gold = got AS met FROM cases"),
    "calibration_statuses": (calibration_statuses, f"""WITH a AS (SELECT vec_id AS query_id, label, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, count(*) AS considered, count(*) FILTER (vec_id % 10 = 5) AS stale,
            count(*) FILTER (vec_id % 10 <> 5 AND round(list_dot_product(embedding::DOUBLE[], q::DOUBLE[]), 6) >= {LEAST_SIMILAR}) AS n_similar FROM embeddings JOIN a USING (label) WHERE vec_id <> query_id GROUP BY query_id)
        SELECT query_id, CASE WHEN query_id % 700 = 0 THEN 'disabled' WHEN considered IS NULL THEN 'empty_corpus' WHEN considered = stale THEN 'no_matches' WHEN len(list_filter(q, lambda x: x <> 0)) = 0 THEN 'embedding_failed' WHEN n_similar = 0 THEN 'no_matches' ELSE 'applied' END AS status,
            coalesce(considered, 0) AS considered, coalesce(stale, 0) AS excluded_stale FROM a LEFT JOIN s USING (query_id)"""),
    "flip_rate": (flip_rate, f"""WITH {_CASES}, p AS (SELECT a.lang, count(*) AS n, count(*) FILTER (a.got IS DISTINCT FROM b.got) AS k, sum(abs(a.got - b.got)) AS d, max(abs(a.got - b.got))::INT AS largest FROM cases a JOIN cases b ON a.lang = b.lang AND a.case_id % 50 = b.case_id % 50 AND a.case_id < b.case_id GROUP BY a.lang)
        SELECT lang, n, k, round({_LOW}, 6) AS low, round({_HIGH}, 6) AS high, round(d / n, 6) AS mean_difference, largest FROM p"""),
}
