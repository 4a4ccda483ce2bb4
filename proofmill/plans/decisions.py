"""From submitted reviews to decisions, from decisions to deliveries, and what became of a batch.

A review is a row that somebody sent; a decision is the first one of a run that was accepted, with the band after its overrides. Only a
decision to approve opens a run for delivery, whatever its status says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofmill.operators import integrity
from proofmill.plans import operations, review, rules
from proofmill.plans.views import CALLS, EVENTS, RUNS, run_events, runs

NOT_APPROVED = "NOT_APPROVED"


def states_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.resolved(rules.evidence_counts(spark, sf_dir), rules.criteria(spark))


def overrides_of(decided: DataFrame, states: DataFrame) -> DataFrame:
    """(run_id, ord, new_state): every seventh decided run has criterion 2 overridden, to the opposite of what it was."""
    asked = decided.where(F.col("run_id") % 7 == 0).select("run_id")
    return states.where(F.col("ord") == 2).join(asked, "run_id", "left_semi").select("run_id", "ord", F.when(F.col("state") == "met", "not_met").otherwise("met").alias("new_state"))


def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision of each run: the first review that was accepted, with the status that follows, the band before and after its overrides, and their number.

    A review is refused, and so decides nothing, if its run is unknown, nobody is named, its action is not legal from the run's status, or
    the version it was made on is not the current one. With overrides the band is computed again from the states as overridden.
    """
    c = F.col
    follows = F.element_at(F.create_map(*(F.lit(x) for pair in review.ACTIONS.items() for x in pair)), c("action"))
    legal = rules.edges(spark).select(c("src").alias("status"), c("dst").alias("next"))
    sent = review.submissions(spark, sf_dir).withColumn("next", follows).where(c("reviewer").isNotNull() & (c("version") == c("expects")))
    accepted = sent.join(F.broadcast(legal), ["status", "next"], "left_semi").join(run_events(spark, sf_dir).select("event_id", "happened"), "event_id")
    first = accepted.groupBy("run_id").agg(F.min(F.struct("happened", "event_id", "action", "next", "reviewer")).alias("d")).select("run_id", "d.*")
    states = states_of(spark, sf_dir)
    given = overrides_of(first, states)
    computed = rules.recommended(states).select("run_id", c("band").alias("band_before"))
    moved = rules.overridden(states.join(given.select("run_id").distinct(), "run_id", "left_semi"), given)
    again = rules.recommended(moved).select("run_id", c("band").alias("band_after"), F.lit(1).alias("n_overrides"))
    rows = first.join(computed, "run_id", "left").join(again, "run_id", "left")
    return rows.select("run_id", "event_id", "action", c("next").alias("status"), "reviewer", c("happened").alias("decided_at"), "band_before", F.coalesce("band_after", "band_before").alias("band"), F.coalesce("n_overrides", F.lit(0)).cast("bigint").alias("n_overrides"))


def delivery_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each run's delivery.

    Refused without a decision to approve. Else delivered if every sink took it; if only some did it is degraded, if none it failed,
    and both wait for another try; the sinks that did not take it are named.
    """
    c = F.col
    decided = review_decisions(spark, sf_dir).select("run_id", "action")
    tried = review.attempts_to_deliver(spark, sf_dir).where("ok").select("run_id", "sink")
    took = tried.groupBy("run_id").agg(F.collect_set("sink").alias("took"))
    rows = runs(spark, sf_dir).select("run_id").join(decided, "run_id", "left").join(took, "run_id", "left")
    missing = F.array_except(F.array(*map(F.lit, review.SINKS)), F.coalesce("took", F.array().cast("array<string>")))
    refused = F.coalesce(c("action") != "approve", F.lit(True))
    outcome = F.when(refused, "refused").when(F.size(missing) == 0, "delivered").when(F.size(missing) == len(review.SINKS), "failed").otherwise("degraded")
    status = F.when(refused, "needs_review").when(outcome == "delivered", "delivered").otherwise("delivery_pending_retry")
    return rows.select("run_id", outcome.alias("outcome"), status.alias("status"), F.when(refused, NOT_APPROVED).alias("error"), F.when(refused, "").otherwise(F.array_join(F.array_sort(missing), ",")).alias("missing"))


def delivery_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every sink is given of an approved run: the outcome and the reasons, never the evidence.

    The band is the one that was approved: after overrides if there are any, else as computed, else unknown. States are those that were computed.
    """
    c = F.col
    decided = review_decisions(spark, sf_dir).where(c("action") == "approve")
    states = states_of(spark, sf_dir)
    listed = states.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "criterion", "state"))), lambda x: F.concat_ws("=", x["criterion"], x["state"])), " | ").alias("criterion_states"))
    told = rules.recommended(states).select("run_id", "score", "coverage")
    tier = integrity.integrity_tiers(spark, sf_dir).select(c("id").alias("run_id"), c("tier").alias("integrity_tier"))
    rows = decided.join(runs(spark, sf_dir).select("run_id", c("candidate").alias("candidate_id"), c("policy").alias("role_id")), "run_id")
    for more in (told, listed, tier):
        rows = rows.join(more, "run_id", "left")
    return rows.select(
        "run_id", "candidate_id", "role_id", F.coalesce("band", F.lit("unknown")).alias("band"), "score", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), c("reviewer").alias("reviewer_id"), c("action").alias("reviewer_action"),
        "decided_at", F.coalesce("criterion_states", F.lit("")).alias("criterion_states"), c("n_overrides").alias("override_count"), F.coalesce("integrity_tier", F.lit("clean")).alias("integrity_tier"),
    )


def batch_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each policy's batch: all its runs, those that a person can look at, quarantined ones, others that need a person, reused ones, and failed ones.

    A run that another one of the same content claims is reused; one without a recommendation failed and is nothing else.
    """
    c = F.col
    flags = rules.review_flags(spark, sf_dir).select("run_id", "status")
    judged = rules.recommended(states_of(spark, sf_dir)).select("run_id", F.lit(True).alias("judged"))
    tier = integrity.integrity_tiers(spark, sf_dir).where(c("tier") == "quarantine").select(c("id").alias("run_id"), F.lit(True).alias("held"))
    reused = operations.claims(spark, sf_dir).select("run_id", (~c("claims")).alias("reused"))
    rows = runs(spark, sf_dir).select("run_id", "policy").join(flags, "run_id").join(judged, "run_id", "left").join(tier, "run_id", "left").join(reused, "run_id")
    ok, held = c("judged").isNotNull(), c("held").isNotNull()
    return rows.groupBy("policy").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("reviewable"), F.count_if(ok & held).alias("quarantined"), F.count_if(ok & ~held & (c("status") == "needs_review")).alias("flagged"),
        F.count_if(ok & c("reused")).alias("reused"), F.count_if(~ok).alias("failed"),
    )


_ACTION = review._pick_sql(tuple(review.ACTIONS), "event_id % 3")
_NEXT = review._pick_sql(tuple(review.ACTIONS.values()), "event_id % 3")
_DECIDED = f"""{RUNS}, {EVENTS}, {rules._COUNTS}, {rules._EDGES}, {rules._recommend('s', 'rec')},
sb AS (SELECT e.event_id, e.run_id, e.happened, {_ACTION} AS action, {_NEXT} AS next, CASE WHEN event_id % 17 <> 0 THEN 'r' || event_id % 9 END AS reviewer, event_id % 2 AS expects, CASE WHEN status = 'structured' THEN 'ready_for_review' ELSE status END AS status, override_count AS version
    FROM run_events e JOIN runs USING (run_id) WHERE kind IN ('view', 'click')),
fd AS (SELECT * FROM sb WHERE reviewer IS NOT NULL AND version = expects AND EXISTS (FROM edge WHERE src = sb.status AND dst = next) QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY happened, event_id) = 1),
ov AS (SELECT s.* REPLACE (CASE WHEN ord = 2 THEN CASE state WHEN 'met' THEN 'not_met' ELSE 'met' END ELSE state END AS state, CASE WHEN ord = 2 THEN NULL ELSE unassessed END AS unassessed) FROM s JOIN fd USING (run_id) WHERE s.run_id % 7 = 0), {rules._recommend('ov', 'aft')},
dc AS (SELECT fd.run_id, event_id, action, next AS status, reviewer, happened AS decided_at, rec.band AS band_before, coalesce(aft.band, rec.band) AS band, (aft.run_id IS NOT NULL)::BIGINT AS n_overrides FROM fd LEFT JOIN rec USING (run_id) LEFT JOIN aft USING (run_id))"""
_SINKS = ", ".join(f"('{s}')" for s in review.SINKS)
QUERIES = {
    "review_decisions": (review_decisions, f"WITH {_DECIDED} SELECT * FROM dc"),
    "delivery_outcomes": (delivery_outcomes, f"""WITH {_DECIDED}, {review._TRIED}, dk AS (SELECT r.run_id, action, string_agg(x.sink, ',' ORDER BY x.sink) FILTER (NOT coalesce(ok, false)) AS missing, count(*) FILTER (ok) AS n_ok
            FROM runs r CROSS JOIN (VALUES {_SINKS}) AS x(sink) LEFT JOIN dc USING (run_id) LEFT JOIN t ON t.run_id = r.run_id AND t.sink = x.sink GROUP BY ALL)
        SELECT run_id, CASE WHEN coalesce(action <> 'approve', true) THEN 'refused' WHEN n_ok = {len(review.SINKS)} THEN 'delivered' WHEN n_ok = 0 THEN 'failed' ELSE 'degraded' END AS outcome,
            CASE WHEN coalesce(action <> 'approve', true) THEN 'needs_review' WHEN n_ok = {len(review.SINKS)} THEN 'delivered' ELSE 'delivery_pending_retry' END AS status,
            CASE WHEN coalesce(action <> 'approve', true) THEN '{NOT_APPROVED}' END AS error, CASE WHEN coalesce(action <> 'approve', true) THEN '' ELSE coalesce(missing, '') END AS missing FROM dk"""),
    "delivery_payloads": (delivery_payloads, f"""WITH {_DECIDED}, tr AS ({integrity.QUERIES['integrity_tiers'][1]}), cs AS (SELECT run_id, string_agg(criterion || '=' || state, ' | ' ORDER BY ord) AS criterion_states FROM s GROUP BY run_id)
        SELECT dc.run_id, candidate AS candidate_id, policy AS role_id, coalesce(dc.band, 'unknown') AS band, rec.score, coalesce(rec.coverage, 0.0) AS coverage, reviewer AS reviewer_id, action AS reviewer_action, decided_at,
            coalesce(criterion_states, '') AS criterion_states, n_overrides AS override_count, coalesce(tier, 'clean') AS integrity_tier
        FROM dc JOIN runs USING (run_id) LEFT JOIN rec ON rec.run_id = dc.run_id LEFT JOIN cs ON cs.run_id = dc.run_id LEFT JOIN tr ON tr.id = dc.run_id WHERE action = 'approve'"""),
    "batch_outcomes": (batch_outcomes, f"""WITH {RUNS}, {rules._COUNTS}, {rules._recommend('s', 'rec')}, fl AS ({rules.QUERIES['review_flags'][1]}), tr AS ({integrity.QUERIES['integrity_tiers'][1]}), cl AS ({operations.QUERIES['claims'][1]})
        SELECT policy, count(*) AS total, count(rec.run_id) AS reviewable, count(rec.run_id) FILTER (coalesce(tier = 'quarantine', false)) AS quarantined, count(rec.run_id) FILTER (NOT coalesce(tier = 'quarantine', false) AND fl.status = 'needs_review') AS flagged,
            count(rec.run_id) FILTER (NOT cl.claims) AS reused, count(*) FILTER (rec.run_id IS NULL) AS failed
        FROM runs r JOIN fl ON fl.run_id = r.run_id JOIN cl ON cl.run_id = r.run_id LEFT JOIN rec ON rec.run_id = r.run_id LEFT JOIN tr ON tr.id = r.run_id GROUP BY policy"""),
}
