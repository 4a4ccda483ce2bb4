"""Review, delivery and the control of runs, and the reports that people read of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofmill import fixtures
from proofmill.functions.stats import share
from proofmill.operators import integrity
from proofmill.plans import operations, rules
from proofmill.plans.views import AS_OF_RUNS, CALLS, EVENTS, RUNS, calls, run_events, runs
from proofmill.tables import read_table

#: Kinds of disagreement that an override names.
REASONS = ("missed_evidence", "wrong_weight", "wrong_state", "context_unknown")
LISTED, CARDS = 500, 20
#: Statuses that a reviewer's action leads to.
ACTIONS = {"approve": "approved", "reject": "rejected", "ask": "needs_info"}
SINKS = ("csv", "sheet")
#: Nodes of a run, the status that each ends in, and the tokens that it is expected to need.
NODES_SCHEMA = "ord int, node string, status string, tokens bigint"
NODES = [(1, "intake", "intake_ok", 0), (2, "extract", "extracted", 0), (3, "sanitize", "sanitized", 0), (4, "structure", "structured", 4000), (5, "assess", "assessed", 9000), (6, "compose", "composed", 2000)]
BUDGET = 20_000


def _pick(names: tuple[str, ...], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), at.cast("int"))


def _pick_sql(names: tuple[str, ...], at: str) -> str:
    return f"(['{"', '".join(names)}'])[({at})::INT + 1]"


# -- reports


def override_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides by the reason given, with the share of each among all."""
    given = runs(spark, sf_dir).where(F.col("override_count") > 0).select(F.explode(F.sequence(F.lit(1), F.col("override_count"))).alias("nth"), "run_id")
    counted = given.groupBy(_pick(REASONS, (F.col("run_id") + F.col("nth")) % 4).alias("reason")).agg(F.count("*").alias("n"))
    # One row for each reason.
    return counted.crossJoin(F.broadcast(counted.agg(F.sum("n").alias("all")))).select("reason", "n", F.round(share(F.col("n"), F.col("all")), 6).alias("share"))


def trust_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings that reviewers gave, from 1 to 5; reviews without one are left out."""
    rating = F.nullif(F.col("event_id") % 6, F.lit(0))
    return run_events(spark, sf_dir).where(F.col("kind") == "click").select(rating.alias("rating")).where(F.col("rating").isNotNull()).groupBy("rating").agg(F.count("*").alias("n"))


def findings_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by detector and severity, with how many of them are sure."""
    found = integrity.text_findings(spark, sf_dir)
    return found.groupBy("detector", "severity").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") >= integrity.QUARANTINE_AT).alias("n_sure"))


def finished_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest 500 runs that finished more than a thousand days ago, oldest first; ties by run."""
    cutoff = F.lit(AS_OF_RUNS).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(1000))
    return runs(spark, sf_dir).where(F.col("finished_at") < cutoff).orderBy("finished_at", "run_id").limit(LISTED).select("run_id", "finished_at")


def evidence_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of each run in order, accepted and rejected items numbered apart, so either list is a filter."""
    order = ["call_no", "latency_ms", "input_tokens", "cached_tokens"]
    nth = F.row_number().over(Window.partitionBy("run_id", "escalated").orderBy(*order))
    return calls(spark, sf_dir).select("run_id", F.col("escalated").alias("rejected"), nth.cast("bigint").alias("nth"), "call_no")


def cards_of_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 cards of each role and exact rubric version.

    A card is made of an approved run: its band is the reviewer's where an override was made, else "hold". Only approvals
    make cards. The top of each role is taken per partition first, so no task ranks all runs of a role.
    """
    made = runs(spark, sf_dir).where((F.col("status") == "delivered") & (F.col("run_id") % 4 != 0))
    band = F.when(F.col("override_count") > 0, _pick(("advance", "decline", "advance"), F.col("override_count") - 1)).otherwise("hold")
    cards = made.select("run_id", F.col("policy").alias("role"), F.concat(F.lit("v"), F.year("started_at") % 2).alias("rubric"), "finished_at", band.alias("band"))
    order = [F.desc("finished_at"), F.col("run_id")]
    part = cards.withColumn("part", F.pmod(F.xxhash64("run_id"), F.lit(64)))
    first = part.withColumn("nth", F.row_number().over(Window.partitionBy("role", "rubric", "part").orderBy(*order))).where(F.col("nth") <= CARDS)
    nth = F.row_number().over(Window.partitionBy("role", "rubric").orderBy(*order))
    return first.withColumn("nth", nth.cast("bigint")).where(F.col("nth") <= CARDS).select("role", "rubric", "nth", "run_id", "band")


def cached_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by the fingerprint of prompt, tier and settings: the first of a key asks, later ones are served and use no fresh tokens."""
    key = F.sha2(F.concat_ws("|", "site", "tier", F.col("input_tokens").cast("string"), (F.col("latency_ms") % 50).cast("string"), F.lit("prompts-1")), 256)
    keyed = calls(spark, sf_dir).select("site", key.alias("cache_key"), "input_tokens", "output_tokens")
    by_key = keyed.groupBy("site", "cache_key").agg(F.count("*").alias("n"), F.max("input_tokens").alias("i"), F.max("output_tokens").alias("o"))
    return by_key.groupBy("site").agg(F.sum("n").alias("n_calls"), F.count("*").alias("n_asked"), F.sum(F.col("n") - 1).alias("n_served"), F.sum(F.col("i") + F.col("o")).alias("fresh_tokens"))


def latest_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest review of each run, by time then id, with its overrides by criterion; "" without any. An older review's overrides do not count."""
    reviews = run_events(spark, sf_dir).where(F.col("kind") == "purchase")
    ords = F.explode(F.sequence(F.lit(1), F.lit(len(rules.CRITERIA)))).alias("ord")
    overrides = reviews.select("event_id", ords).where((F.col("event_id") + F.col("ord")) % 4 == 0).withColumn("reason", _pick(REASONS, (F.col("event_id") + 2 * F.col("ord")) % 4))
    items = F.array_sort(F.collect_list(F.struct("ord", "reason")))
    listed = overrides.groupBy("event_id").agg(F.array_join(F.transform(items, lambda x: F.concat_ws(":", x["ord"].cast("string"), x["reason"])), ",").alias("overrides"))
    newest = reviews.groupBy("run_id").agg(F.max_by("event_id", F.struct("happened", "event_id")).alias("event_id"))
    return newest.join(listed, "event_id", "left").select("run_id", "event_id", F.coalesce("overrides", F.lit("")).alias("overrides"))


def current_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text the newest scan that none replaced, by time then id, with the findings of the text; "" without any."""
    scans = run_events(spark, sf_dir).where((F.col("kind") == "view") & (F.col("event_id") % 5 != 0))
    newest = scans.groupBy(F.col("run_id").alias("id")).agg(F.max_by("event_id", F.struct("happened", "event_id")).alias("report_id"))
    # One finding of a detector for each text at most, so a list is short.
    items = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "detector", "severity"))), ",")
    listed = integrity.text_findings(spark, sf_dir).groupBy("id").agg(items.alias("findings"))
    return newest.join(listed, "id", "left").select("id", "report_id", F.coalesce("findings", F.lit("")).alias("findings"))


# -- review and delivery


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, run_id, action, reviewer, expects, status, version): reviews as submitted, with the state of their run."""
    known = runs(spark, sf_dir).select("run_id", F.when(F.col("status") == "structured", "ready_for_review").otherwise(F.col("status")).alias("status"), F.col("override_count").alias("version"))
    sent = run_events(spark, sf_dir).where(F.col("kind").isin("view", "click")).select(
        "event_id", "run_id", _pick(tuple(ACTIONS), F.col("event_id") % 3).alias("action"), F.when(F.col("event_id") % 17 != 0, F.concat(F.lit("r"), F.col("event_id") % 9)).alias("reviewer"), (F.col("event_id") % 2).alias("expects")
    )
    return sent.join(known, "run_id", "left")


def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of submitted reviews: refused with a code, or accepted with the status that follows.

    In this order: the run is unknown, no reviewer is named, the action is not legal from the run's status, the version
    read is not the current one.
    """
    follows = F.element_at(F.create_map(*(F.lit(x) for pair in ACTIONS.items() for x in pair)), F.col("action"))
    sent = submissions(spark, sf_dir).withColumn("next", follows)
    legal = rules.edges(spark).select(F.col("src").alias("status"), F.col("dst").alias("next"), F.lit(True).alias("legal"))
    judged = sent.join(F.broadcast(legal), ["status", "next"], "left")
    code = F.when(F.col("status").isNull(), "run_unknown").when(F.col("reviewer").isNull(), "reviewer_required").when(F.col("legal").isNull(), "illegal_transition").when(F.col("version") != F.col("expects"), "stale_version").otherwise("accepted")
    return judged.select(code.alias("outcome"), F.when(code == "accepted", F.col("next")).alias("status")).groupBy("outcome", "status").agg(F.count("*").alias("n"))


def attempts_to_deliver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run_id, sink, ok): one try of each sink for each decided run; no row where a sink was not tried."""
    sink = _pick(SINKS, F.col("call_no") - 1)
    return calls(spark, sf_dir).where(F.col("call_no") <= 2).groupBy("run_id", sink.alias("sink")).agg(F.bool_or(F.col("latency_ms") % 5 != 0).alias("ok"))


def delivery_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I12 by status alone (the whole rule is ``decisions.delivery_outcomes``): each run's delivery: refused unless approved, delivered if every sink took it, pending if some did not or were not tried."""
    tried = attempts_to_deliver(spark, sf_dir).groupBy("run_id").agg(F.count_if("ok").alias("n_ok"))
    joined = runs(spark, sf_dir).join(tried, "run_id", "left")
    status = F.when(F.col("status") != "delivered", "refused").when(F.coalesce("n_ok", F.lit(0)) == len(SINKS), "delivered").otherwise("delivery_pending_retry")
    return joined.select("run_id", status.alias("delivery"), F.coalesce("n_ok", F.lit(0)).alias("n_ok"))


def deliveries_by_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered runs with a column for each sink: whether it took the run, null where it was not tried."""
    tried = attempts_to_deliver(spark, sf_dir).groupBy("run_id").pivot("sink", [*SINKS]).agg(F.bool_or("ok"))
    return runs(spark, sf_dir).where(F.col("status") == "delivered").select("run_id").join(tried, "run_id", "left").select("run_id", *SINKS)


# -- control


def next_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """I4: of the statuses that events propose, how many are taken as legal from the run's last node; else the node's own follows."""
    proposed = F.element_at(F.create_map(*(F.lit(x) for pair in rules.KINDS.items() for x in pair)), F.col("kind"))
    nodes = fixtures.frame(spark, NODES_SCHEMA, NODES)
    asked = run_events(spark, sf_dir).select(proposed.alias("proposed"), (F.col("event_id") % len(NODES) + 1).cast("int").alias("ord"))
    declared, before = nodes.select("ord", F.col("status").alias("declared")), nodes.select((F.col("ord") + 1).alias("ord"), F.col("status").alias("src"))
    joined = asked.join(F.broadcast(declared), "ord").join(F.broadcast(before), "ord", "left").withColumn("src", F.coalesce("src", F.lit("created")))
    legal = rules.edges(spark).select("src", F.col("dst").alias("proposed"), F.lit(True).alias("legal"))
    taken = joined.join(F.broadcast(legal), ["src", "proposed"], "left")
    return taken.groupBy("src", F.when(F.col("legal"), F.col("proposed")).otherwise(F.col("declared")).alias("status")).agg(F.count("*").alias("n"), F.count_if("legal").alias("n_proposed"))


def next_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each run the first node that it has not completed and can still pay for, else why it stops.

    Completed nodes are found by an anti join on (run, node), so running twice does nothing twice.
    """
    nodes = F.broadcast(fixtures.frame(spark, NODES_SCHEMA, NODES))
    spent = calls(spark, sf_dir).groupBy("run_id").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("spent"), F.max("call_no").alias("done"))
    known = runs(spark, sf_dir).select("run_id").join(spent, "run_id", "left").na.fill(0, ["spent", "done"])
    completed = known.join(nodes, F.col("ord") < F.col("done")).select("run_id", "node")
    due = known.crossJoin(nodes).join(completed, ["run_id", "node"], "left_anti")
    first = due.groupBy("run_id").agg(F.min(F.struct("ord", "node", "tokens", "spent")).alias("f"))
    state = F.when(F.col("f").isNull(), "finished").when(F.col("f.spent") + F.col("f.tokens") > BUDGET, "budget_exceeded").otherwise("run")
    return known.select("run_id").join(first, "run_id", "left").select("run_id", state.alias("state"), F.when(state == "run", F.col("f.node")).alias("node"))


def delete_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each candidate whether all its runs may be deleted: none in flight, and not all of them samples."""
    sample, flight = F.col("run_id") % 5 == 0, F.col("finished_at").isNull()
    by_candidate = runs(spark, sf_dir).groupBy("candidate").agg(F.count("*").alias("n_runs"), F.bool_or(flight).alias("in_flight"), F.bool_and(sample).alias("all_sample"))
    verdict = F.when(F.col("in_flight"), "in_flight").when(F.col("all_sample"), "sample").otherwise("may_delete")
    return by_candidate.select("candidate", "n_runs", verdict.alias("verdict"))


def reassessments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A new candidate reference for each stored candidate with finished runs, with the documents that it takes over."""
    done = runs(spark, sf_dir).where(F.col("finished_at").isNotNull()).groupBy("candidate").agg(F.count("*").alias("n_runs"))
    docs = read_table(spark, sf_dir, "documents").select((F.col("doc_id") % 1000).alias("candidate"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    held = docs.groupBy("candidate").agg(F.count_distinct("sha").alias("n_documents"), F.min("sha").alias("first_sha"))
    ref = F.concat(F.lit("again-"), F.substring(F.sha2(F.concat_ws("|", F.col("candidate").cast("string"), "first_sha"), 256), 1, 12))
    return done.join(held, "candidate").select("candidate", ref.alias("new_ref"), "n_runs", "n_documents")


def draft_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overrides as draft cases: for each run the last state given to each criterion, as criterion=state in order."""
    given = run_events(spark, sf_dir).where(F.col("kind") == "purchase").select("run_id", F.concat(F.lit("c"), F.col("event_id") % 3 + 1).alias("criterion"), _pick(("met", "partial", "not_met"), F.floor(F.col("value")) % 3).alias("state"), "happened", "event_id")
    last = given.groupBy("run_id", "criterion").agg(F.max_by("state", F.struct("happened", "event_id")).alias("state"))
    pairs = F.array_sort(F.collect_list(F.concat_ws("=", "criterion", "state")))
    return last.groupBy("run_id").agg(F.array_join(pairs, ",").alias("states"))


#: The fields that may leave in a notification, and the texts by kind.
ALLOWED_FIELDS = ("kind", "count", "ready_count", "flagged_count", "failed_count", "role_id", "link", "sink_id", "error_code", "occurred_at")
NOTICES = {
    "batch_ready": "{ready_count} candidate(s) ready to review for {role_id}{flagged}.",
    "delivery_failed": "{failed_count} result(s) could not be sent to {sink_id} ({error_code}). They are saved and will retry.",
    "quarantine_detected": "{count} document(s) were flagged as containing content aimed at an automated reader. Nothing was assessed and nothing was spent.",
}
LINK_LABEL = "Open the queue"
#: What stands for a field that is not there.
MISSING = {"ready_count": "0", "failed_count": "0", "count": "0", "role_id": "this role", "sink_id": "the destination", "error_code": "unknown"}


def notified(rows: DataFrame) -> DataFrame:
    """(kind, payload, text) of rows with a kind and any other columns.

    The payload has the allowed fields that say something, in their order; a blank or 0 says nothing, and a column that is not
    allowed stays behind whatever it holds. The text is filled from the payload alone.
    """
    c = F.col
    have = {f: F.nullif(F.nullif(c(f).cast("string"), F.lit("")), F.lit("0")) if f in rows.columns else F.lit(None).cast("string") for f in ALLOWED_FIELDS}
    payload = F.concat_ws("; ", *(F.concat(F.lit(f"{f}="), have[f]) for f in ALLOWED_FIELDS))
    flagged = F.when(have["flagged_count"].isNotNull(), F.concat(F.lit(", "), have["flagged_count"], F.lit(" needing a closer look"))).otherwise("")
    text = F.lit(None).cast("string")
    for kind, template in NOTICES.items():
        filled = F.lit(template)
        for field, instead in MISSING.items():
            filled = F.replace(filled, F.lit(f"{{{field}}}"), F.coalesce(have[field], F.lit(instead)))
        text = F.when(c("kind") == kind, F.replace(filled, F.lit("{flagged}"), flagged)).otherwise(text)
    linked = F.when(have["link"].isNotNull(), F.concat(text, F.lit(" <"), have["link"], F.lit(f"|{LINK_LABEL}>"))).otherwise(text)
    return rows.select("kind", payload.alias("payload"), linked.alias("text"))


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is sent about each policy's runs: those ready and flagged, those not delivered, those held back. The candidate and overrides stay behind."""
    c = F.col
    waiting = c("status") == "structured"
    counted = runs(spark, sf_dir).groupBy("policy").agg(
        F.max("candidate").alias("candidate"), F.sum("override_count").alias("overrides"), F.count_if(waiting).alias("ready"), F.count_if(waiting & (c("override_count") > 1)).alias("flagged"),
        F.count_if(c("status") == "needs_review").alias("failed"), F.count_if(c("override_count") > 2).alias("held"),
    )
    n = lambda of: F.lit(None).cast("bigint") if of is None else c(of)
    said = lambda x: F.lit(None).cast("string") if x is None else x

    def one(kind: str, ready: str | None = None, flagged: str | None = None, failed: str | None = None, count: str | None = None, role: Column | None = None, link: Column | None = None, code: Column | None = None) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), n(ready).alias("ready_count"), n(flagged).alias("flagged_count"), n(failed).alias("failed_count"), n(count).alias("count"), said(role).alias("role_id"), said(link).alias("link"), said(code).alias("error_code"), c("candidate"), c("overrides")
        )

    kinds = F.array(
        one("batch_ready", ready="ready", flagged="flagged", role=c("policy"), link=F.lit("https://queue.test/")),
        one("delivery_failed", failed="failed", code=F.when(c("failed") % 2 == 0, "transient").otherwise("")),
        one("quarantine_detected", count="held"),
    )
    return notified(counted.select(F.explode(kinds).alias("m")).select("m.*"))


_E, _R = "WITH " + EVENTS, "WITH " + RUNS
_EDGES = fixtures.sql("edge", "src string, dst string", rules.EDGE_ROWS)
_NODES = fixtures.sql("node", NODES_SCHEMA, NODES)
_TRIED = f"t AS (SELECT run_id, {_pick_sql(SINKS, 'call_no - 1')} AS sink, bool_or(latency_ms % 5 <> 0) AS ok FROM calls WHERE call_no <= 2 GROUP BY ALL)"
_KIND = "CASE kind " + " ".join(f"WHEN '{k}' THEN '{s}'" for k, s in rules.KINDS.items()) + " END"

QUERIES = {
    "override_reasons": (override_reasons, f"""{_R}, g AS (SELECT {_pick_sql(REASONS, '(run_id + nth) % 4')} AS reason, count(*) AS n FROM runs, range(1, override_count + 1) AS r(nth) GROUP BY 1)
        SELECT reason, n, round(n / sum(n) OVER (), 6) AS share FROM g"""),
    "trust_ratings": (trust_ratings, f"{_E} SELECT nullif(event_id % 6, 0) AS rating, count(*) AS n FROM run_events WHERE kind = 'click' AND event_id % 6 <> 0 GROUP BY 1"),
    "findings_by_severity": (findings_by_severity, f"SELECT detector, severity, count(*) AS n, count(*) FILTER (confidence >= {integrity.QUARANTINE_AT}) AS n_sure FROM ({integrity.QUERIES['text_findings'][1]}) GROUP BY ALL"),
    "finished_before": (finished_before, f"{_R} SELECT run_id, finished_at FROM runs WHERE finished_at < TIMESTAMP '{AS_OF_RUNS}' - INTERVAL 1000 DAY ORDER BY finished_at, run_id LIMIT {LISTED}"),
    "evidence_of_runs": (evidence_of_runs, f"WITH {CALLS} SELECT run_id, escalated AS rejected, row_number() OVER (PARTITION BY run_id, escalated ORDER BY call_no, latency_ms, input_tokens, cached_tokens) AS nth, call_no FROM calls"),
    "cards_of_roles": (cards_of_roles, f"""{_R}, c AS (SELECT run_id, policy AS role, 'v' || (year(started_at) % 2) AS rubric, finished_at, CASE WHEN override_count > 0 THEN {_pick_sql(("advance", "decline", "advance"), "override_count - 1")} ELSE 'hold' END AS band
            FROM runs WHERE status = 'delivered' AND run_id % 4 <> 0)
        SELECT role, rubric, row_number() OVER (PARTITION BY role, rubric ORDER BY finished_at DESC, run_id) AS nth, run_id, band FROM c QUALIFY nth <= {CARDS}"""),
    "cached_responses": (cached_responses, f"""WITH {CALLS}, k AS (SELECT site, tier, input_tokens, latency_ms % 50 AS t, count(*) AS n, max(input_tokens) + max(output_tokens) AS f FROM calls GROUP BY ALL)
        SELECT site, sum(n)::BIGINT AS n_calls, count(*) AS n_asked, sum(n - 1)::BIGINT AS n_served, sum(f)::BIGINT AS fresh_tokens FROM k GROUP BY site"""),
    "latest_reviews": (latest_reviews, f"""{_E}, r AS (SELECT * FROM run_events WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY happened DESC, event_id DESC) = 1)
        SELECT run_id, event_id, coalesce(string_agg(ord || ':' || {_pick_sql(REASONS, '(event_id + 2 * ord) % 4')}, ',' ORDER BY ord) FILTER ((event_id + ord) % 4 = 0), '') AS overrides FROM r, range(1, {len(rules.CRITERIA) + 1}) AS o(ord) GROUP BY ALL"""),
    "current_reports": (current_reports, f"""{_E}, s AS (SELECT run_id AS id, event_id AS report_id FROM run_events WHERE kind = 'view' AND event_id % 5 <> 0 QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY happened DESC, event_id DESC) = 1),
        f AS (SELECT id, string_agg(detector || ':' || severity, ',' ORDER BY detector, severity) AS findings FROM ({integrity.QUERIES['text_findings'][1]}) GROUP BY id) SELECT id, report_id, coalesce(findings, '') AS findings FROM s LEFT JOIN f USING (id)"""),
    "review_outcomes": (review_outcomes, f"""WITH {RUNS}, {EVENTS}, {_EDGES}, s AS (SELECT e.event_id, e.run_id, {_pick_sql(tuple(ACTIONS.values()), "event_id % 3")} AS next, event_id % 17 <> 0 AS named, event_id % 2 AS expects,
            CASE WHEN status = 'structured' THEN 'ready_for_review' ELSE status END AS status, override_count AS version FROM run_events e LEFT JOIN runs USING (run_id) WHERE kind IN ('view', 'click')),
        o AS (SELECT CASE WHEN status IS NULL THEN 'run_unknown' WHEN NOT named THEN 'reviewer_required' WHEN NOT EXISTS (FROM edge WHERE src = status AND dst = next) THEN 'illegal_transition' WHEN version <> expects THEN 'stale_version' ELSE 'accepted' END AS outcome, next FROM s)
        SELECT outcome, CASE WHEN outcome = 'accepted' THEN next END AS status, count(*) AS n FROM o GROUP BY ALL"""),
    "delivery_status": (delivery_status, f"""WITH {RUNS}, {CALLS}, {_TRIED}, k AS (SELECT run_id, count(*) FILTER (ok) AS n_ok FROM t GROUP BY run_id)
        SELECT run_id, CASE WHEN status <> 'delivered' THEN 'refused' WHEN coalesce(n_ok, 0) = {len(SINKS)} THEN 'delivered' ELSE 'delivery_pending_retry' END AS delivery, coalesce(n_ok, 0) AS n_ok FROM runs LEFT JOIN k USING (run_id)"""),
    "deliveries_by_sink": (deliveries_by_sink, f"WITH {RUNS}, {CALLS}, {_TRIED} SELECT run_id, bool_or(ok) FILTER (sink = 'csv') AS csv, bool_or(ok) FILTER (sink = 'sheet') AS sheet FROM runs LEFT JOIN t USING (run_id) WHERE status = 'delivered' GROUP BY run_id"),
    "next_status": (next_status, f"""WITH {EVENTS}, {_EDGES}, {_NODES}, a AS (SELECT {_KIND} AS proposed, coalesce(b.status, 'created') AS src, d.status AS declared FROM run_events JOIN node d ON d.ord = event_id % {len(NODES)} + 1 LEFT JOIN node b ON b.ord = d.ord - 1),
        l AS (SELECT *, EXISTS (FROM edge e WHERE e.src = a.src AND e.dst = proposed) AS legal FROM a)
        SELECT src, CASE WHEN legal THEN proposed ELSE declared END AS status, count(*) AS n, count(*) FILTER (legal) AS n_proposed FROM l GROUP BY ALL"""),
    "next_nodes": (next_nodes, f"""WITH {RUNS}, {CALLS}, {_NODES}, u AS (SELECT run_id, sum(input_tokens + output_tokens) AS spent, max(call_no) AS done FROM calls GROUP BY run_id),
        k AS (SELECT run_id, coalesce(spent, 0) AS spent, coalesce(done, 0) AS done FROM runs LEFT JOIN u USING (run_id)), d AS (SELECT * FROM k LEFT JOIN node ON ord = greatest(done, 1))
        SELECT run_id, CASE WHEN node IS NULL THEN 'finished' WHEN spent + tokens > {BUDGET} THEN 'budget_exceeded' ELSE 'run' END AS state, CASE WHEN spent + tokens <= {BUDGET} THEN node END AS node FROM d"""),
    "delete_guard": (delete_guard, f"{_R} SELECT candidate, count(*) AS n_runs, CASE WHEN bool_or(finished_at IS NULL) THEN 'in_flight' WHEN bool_and(run_id % 5 = 0) THEN 'sample' ELSE 'may_delete' END AS verdict FROM runs GROUP BY candidate"),
    "reassessments": (reassessments, f"""{_R}, d AS (SELECT candidate, count(*) AS n_runs FROM runs WHERE finished_at IS NOT NULL GROUP BY candidate),
        h AS (SELECT doc_id % 1000 AS candidate, count(DISTINCT sha256(coalesce(text, ''))) AS n_documents, min(sha256(coalesce(text, ''))) AS first_sha FROM documents GROUP BY 1)
        SELECT candidate, 'again-' || substring(sha256(candidate || '|' || first_sha), 1, 12) AS new_ref, n_runs, n_documents FROM d JOIN h USING (candidate)"""),
    "draft_cases": (draft_cases, f"""{_E}, g AS (SELECT run_id, 'c' || (event_id % 3 + 1) AS criterion, {_pick_sql(("met", "partial", "not_met"), "floor(value) % 3")} AS state FROM run_events WHERE kind = 'purchase'
            QUALIFY row_number() OVER (PARTITION BY run_id, event_id % 3 ORDER BY happened DESC, event_id DESC) = 1)
        SELECT run_id, string_agg(criterion || '=' || state, ',' ORDER BY criterion) AS states FROM g GROUP BY run_id"""),
    "notifications": (notifications, f"""{_R}, g AS (SELECT policy, count(*) FILTER (status = 'structured') AS ready, count(*) FILTER (status = 'structured' AND override_count > 1) AS flagged, count(*) FILTER (status = 'needs_review') AS failed, count(*) FILTER (override_count > 2) AS held FROM runs GROUP BY policy)
        SELECT 'batch_ready' AS kind, concat_ws('; ', 'kind=batch_ready', 'ready_count=' || nullif(ready, 0), 'flagged_count=' || nullif(flagged, 0), 'role_id=' || policy, 'link=https://queue.test/') AS payload,
            ready || ' candidate(s) ready to review for ' || policy || CASE WHEN flagged > 0 THEN ', ' || flagged || ' needing a closer look' ELSE '' END || '. <https://queue.test/|{LINK_LABEL}>' AS text FROM g
        UNION ALL SELECT 'delivery_failed', concat_ws('; ', 'kind=delivery_failed', 'failed_count=' || nullif(failed, 0), CASE WHEN failed % 2 = 0 THEN 'error_code=transient' END),
            failed || ' result(s) could not be sent to the destination (' || CASE WHEN failed % 2 = 0 THEN 'transient' ELSE 'unknown' END || '). They are saved and will retry.' FROM g
        UNION ALL SELECT 'quarantine_detected', concat_ws('; ', 'kind=quarantine_detected', 'count=' || nullif(held, 0)), held || ' document(s) were flagged as containing content aimed at an automated reader. Nothing was assessed and nothing was spent.' FROM g"""),
}
