"""Sources, sinks, state, deletion and schemas: what has a state or a folder of its own."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from proofmill.operators import evidence
from proofmill.plans import flips, rules
from proofmill.sources import deletion, delivery, ledger, remote, schemas
from proofmill.tables import read_table

NAMES = ("Ana_CV.pdf", "ana_letter.txt", "Bo-cv.pdf", "bo-2.md", "Cy Smith.txt", "solo.txt", "_odd.txt", "a-b_c.txt", "noend", ".hidden")


# -- the remote folder


class FlakyTransport(remote.FolderTransport):
    """Each file's first read is cut short; a file called denied is refused."""

    tried: set[str] = set()

    def download(self, ref):
        data, _ = super().download(ref)
        if "denied" in ref:
            error = RuntimeError("no")
            error.status = 403
            raise error
        if ref not in self.tried:
            self.tried.add(ref)
            return data[:1], len(data)
        return data, len(data)


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    for i, name in enumerate(NAMES):
        (at / name).write_bytes(name.encode() * (i + 1))
    return at


def test_candidates_by_name(spark):
    want = {"Ana_CV.pdf": "ana", "ana_letter.txt": "ana", "Bo-cv.pdf": "bo", "bo-2.md": "bo", "Cy Smith.txt": "cy", "solo.txt": "solo", "_odd.txt": "_odd", "a-b_c.txt": "a-b", "noend": "noend", ".hidden": "candidate"}
    assert {n: remote.candidate_of(n) for n in NAMES} == want
    native = spark.createDataFrame([(n,) for n in NAMES], "name string").select("name", ledger.candidate_of(F.col("name")).alias("c")).collect()
    assert {r["name"]: r["c"] for r in native} == want


def test_remote_folder_is_read_in_partitions(spark, folder, monkeypatch):
    monkeypatch.setattr(remote.time, "sleep", lambda s: None)
    spark.dataSource.register(remote.CandidateFolder)
    read = spark.read.format("candidate_folder").option("partitions", "4").load(str(folder))
    rows = read.collect()
    assert {r["name"]: bytes(r["content"]) for r in rows} == {n: n.encode() * (i + 1) for i, n in enumerate(NAMES)}
    assert all(r["n_bytes"] == len(r["content"]) and r["candidate"] == remote.candidate_of(r["name"]) for r in rows)
    parts = remote.dealt(remote.listed({"path": str(folder)}), 4)
    assert read.rdd.getNumPartitions() == len(parts) > 1
    of = {e.name: p.prefix for p in parts for e in p.entries}
    assert of["Ana_CV.pdf"] == of["ana_letter.txt"] and of["Bo-cv.pdf"] == of["bo-2.md"]
    empty = folder.parent / "empty"
    empty.mkdir()
    assert spark.read.format("candidate_folder").load(str(empty)).count() == 0


def test_remote_folder_as_a_stream(spark, folder, tmp_path):
    spark.dataSource.register(remote.CandidateFolder)
    stream = spark.readStream.format("candidate_folder").load(str(folder)).select("candidate", "name", "n_bytes")
    start = lambda: stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    start().awaitTermination()
    (folder / "late_one.txt").write_text("more")
    start().awaitTermination()
    start().awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["name"] for r in rows) == sorted([*NAMES, "late_one.txt"])


def test_short_reads_are_tried_again_and_refusals_are_not(folder):
    waits, transport = [], FlakyTransport({"path": str(folder)})
    entries = {e.name: e for e in remote.listed({"path": str(folder)})}
    call = lambda: remote.with_retries(lambda: remote_once(transport, entries["solo.txt"]), "x", sleep=waits.append)

    def remote_once(t, e):
        data, n = t.download(e.ref)
        if len(data) != n:
            raise remote.SourceUnavailable("transient", "short")
        return data

    assert call() == b"solo.txt" * 6 and len(waits) == 1 and 0.35 <= waits[0] <= 0.65
    (folder / "denied.txt").write_text("x")
    tries = []
    with pytest.raises(remote.SourceUnavailable) as refused:
        remote.with_retries(lambda: tries.append(1) or transport.download(str(folder / "denied.txt")), "denied", sleep=waits.append)
    assert refused.value.failure == "auth" and len(tries) == 1
    with pytest.raises(remote.SourceUnavailable):
        remote.listed({})
    assert [remote.failure_class(s) for s in (None, 429, 401, 403, 404, 408, 500, 503, 422)] == ["transient", "rate_limited", "auth", "auth", "config", "permanent", "transient", "transient", "permanent"]
    delays = [remote.backoff(n, random.Random(n)) for n in range(1, 9)]
    assert all(0.5 * 2 ** (n - 1) * 0.7 <= d <= min(8.0, 0.5 * 2 ** (n - 1) * 1.3) or d == 8.0 for n, d in enumerate(delays, 1))


def test_failure_classes_and_schedule_in_columns(spark):
    statuses = [None, 200, 302, 429, 401, 403, 404, 408, 422, 500, 599]
    rows = spark.createDataFrame([(s,) for s in statuses], "status int").select("status", ledger.failure_class(F.col("status")).alias("c")).collect()
    assert {r["status"]: r["c"] for r in rows} == {s: "ok" if s in (200, 302) else remote.failure_class(s) for s in statuses}
    delays = [r["delay"] for r in ledger.retry_schedule(spark, 8, seed=3).orderBy("attempt").collect()]
    assert delays == [r["delay"] for r in ledger.retry_schedule(spark, 8, seed=3).orderBy("attempt").collect()] and max(delays) <= 8.0
    assert all(0.35 * 2**k <= d <= 0.65 * 2**k for k, d in enumerate(delays[:3]))


def test_folders_of_documents(spark, tmp_path):
    for name in ("kim/cv.pdf", "kim/old/letter.txt", "kim/skip.exe", "Lee-cv.txt", "Lee-x_y.md", "mo_cv.txt", "-z.txt"):
        (tmp_path / "docs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "docs" / name).write_text(name)
    got = {r["name"]: r["candidate"] for r in ledger.documents_in(spark, str(tmp_path / "docs")).select("name", "candidate").collect()}
    assert got == {"cv.pdf": "kim", "letter.txt": "kim", "Lee-cv.txt": "Lee", "Lee-x_y.md": "Lee", "mo_cv.txt": "mo", "-z.txt": "-z"}


# -- the sink


def _send(log, answers):
    """A destination that keeps what it gets in a file and answers by run."""

    def send(row):
        with open(log, "a") as f:
            f.write(f"{row['run_id']}\n")
        with open(log) as f:
            nth = f.read().split().count(str(row["run_id"]))
        given = answers.get(int(row["run_id"]), [200])
        status = given[min(nth, len(given)) - 1]
        if status is None:
            raise OSError("gone")
        return status

    return send


def test_each_run_is_delivered_once(spark, tmp_path):
    """A stream whose batches fail, come again and repeat runs."""
    log, path = str(tmp_path / "log"), str(tmp_path / "sink")
    open(log, "w").close()
    answers = {2: [503, 200], 3: [None, 429, 200], 4: [403], 5: [500, 500, 500, 200], 6: [404]}
    send = _send(log, answers)
    deliver = lambda ids, batch: delivery.deliver(spark.createDataFrame([(i, f"n{i}") for i in ids], "run_id bigint, note string"), batch, path, send, sleep=lambda s: None)
    first = {r["run_id"]: (r["ok"], r["failure"], r["attempts"]) for r in deliver([1, 1, 2, 3, 4, 5], 0).collect()}
    assert first == {1: (True, None, 1), 2: (True, None, 2), 3: (True, None, 3), 4: (False, "auth", 1), 5: (False, "transient", 3)}
    before = open(log).read()
    assert {r["run_id"] for r in deliver([1, 2, 3, 4, 5], 0).collect()} == {1, 2, 3, 4, 5} and open(log).read() == before
    second = {r["run_id"]: r["ok"] for r in deliver([1, 2, 5, 6, 7], 1).collect()}
    assert second == {5: True, 6: False, 7: True}
    sent = open(log).read().split()
    assert sent.count("1") == 1 and sent.count("2") == 2 and sent.count("7") == 1
    every = delivery.outcomes_of(spark, path).where("ok").groupBy("run_id").count().collect()
    assert {r["run_id"]: r["count"] for r in every} == {1: 1, 2: 1, 3: 1, 5: 1, 7: 1}


def test_a_batch_that_was_cut_off_is_sent_again(spark, tmp_path):
    import os

    log, path = str(tmp_path / "log"), str(tmp_path / "sink")
    open(log, "w").close()
    rows = spark.createDataFrame([(1,), (2,)], "run_id bigint")
    delivery.deliver(rows, 0, path, _send(log, {}), sleep=lambda s: None)
    os.remove(f"{path}/outcomes/batch=0/_SUCCESS")
    again = delivery.deliver(rows, 0, path, _send(log, {}), sleep=lambda s: None)
    assert again.count() == 2 and sorted(open(log).read().split()) == ["1", "1", "2", "2"]


def test_sink_of_a_stream(spark, tmp_path):
    log, path = str(tmp_path / "log"), str(tmp_path / "sink")
    open(log, "w").close()
    for part in range(3):
        spark.range(part * 4, part * 4 + 6).select(F.col("id").alias("run_id")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream.writeStream.foreachBatch(delivery.sink(path, _send(log, {}))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(map(int, open(log).read().split())) == list(range(14)) and delivery.outcomes_of(spark, path).where("ok").count() == 14


def test_bucket_is_state(spark, tmp_path):
    waits, left = delivery.taken(2.5, 2.0, 5)
    assert waits == [0.0, 0.0, 0.25, 0.5, 0.5] and left == 0.0
    assert delivery.taken(1.0, 0.0, 3)[0] == [0.0] * 3 and delivery.refilled(0.0, 10.0, 11.0, 3.0, 2.0) == 2.0
    path, clock = str(tmp_path / "s"), iter((100.0, 100.5))
    rows = lambda lo, hi: spark.range(lo, hi).select(F.col("id").alias("run_id"))
    options = {"rate": 8.0, "capacity": 16.0, "now": lambda: next(clock), "sleep": lambda s: None}
    delivery.deliver(rows(0, 12), 0, path, lambda row: 200, **options)
    assert delivery.bucket_of(spark, path, 1) == (4.0, 100.0)
    delivery.deliver(rows(12, 14), 1, path, lambda row: 200, **options)
    assert delivery.bucket_of(spark, path, 2) == (6.0, 100.5)


# -- state over a stream


def test_machine_over_a_stream_agrees_with_the_log(spark, data, tmp_path):
    from proofmill.plans.views import run_events
    from proofmill.streaming import machine

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machine.PROVIDER)
    events = run_events(spark, data).withColumn("happened", F.col("happened").cast("timestamp"))
    days = [r["d"] for r in events.select(F.to_date("happened").alias("d")).distinct().orderBy("d").collect()]
    cuts = [days[len(days) // 3], days[2 * len(days) // 3]]
    pieces = [events.where(F.to_date("happened") < cuts[0]), events.where((F.to_date("happened") >= cuts[0]) & (F.to_date("happened") < cuts[1])), events.where(F.to_date("happened") >= cuts[1])]
    out, ceiling = str(tmp_path / "out"), 150.0
    for piece in pieces:
        piece.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        query = machine.machine_alerts(stream, ceiling, idle_hours=24 * 400).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        query.awaitTermination()
    got = {(r["run_id"], r["alert"], r["event_id"], r["src"], r["dst"], None if r["spent"] is None else round(r["spent"], 6)) for r in spark.read.parquet(out).collect()}
    want = {(r["run_id"], r["alert"], r["event_id"], r["src"], r["dst"], None if r["spent"] is None else round(r["spent"], 6)) for r in machine.logged_alerts(events, ceiling).collect()}
    assert got == want and {a for _, a, *_ in want} == {"illegal", "ceiling"}


def test_idle_runs_are_reported_by_a_timer(spark, tmp_path):
    from proofmill.streaming import machine

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", machine.PROVIDER)
    schema = "run_id bigint, event_id bigint, happened timestamp, kind string, value double"
    rows = lambda values: spark.createDataFrame(values, "run_id bigint, event_id bigint, at string, kind string, value double").select("run_id", "event_id", F.to_timestamp("at").alias("happened"), "kind", "value")
    days = [[(1, 1, "2024-01-01 00:00:00", "view", 1.0), (2, 2, "2024-01-01 00:00:00", "view", None)], [(2, 3, "2024-01-03 00:00:00", "click", 2.0)], [(2, 4, "2024-01-05 00:00:00", "click", 2.0)]]
    for day in days:
        rows(day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        machine.machine_alerts(stream, 1e9, idle_hours=36).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    found = sorted((r["run_id"], r["alert"], r["spent"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert (1, "idle", 1.0) in found and sum(r == 1 for r, *_ in found) == 1


# -- deletion and schemas


def test_deletion_rewrites_only_what_it_touches(spark, tmp_path):
    import os

    path = str(tmp_path / "t")
    table = spark.range(60).select(F.col("id").alias("run_id"), (F.col("id") % 5).alias("day"), F.lit("x").alias("note"))
    table.write.partitionBy("day").parquet(path)
    files = lambda: {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    before = files()
    lost = spark.createDataFrame([(i,) for i in [*range(0, 60, 5), 1, 999, 1]], "run_id bigint")
    assert deletion.rewrite(spark, path, "run_id", lost, "day") == (1, 1)
    kept = sorted(r["run_id"] for r in spark.read.parquet(path).collect())
    assert kept == [i for i in range(60) if i % 5 and i != 1]
    assert {f for f in before if "day=2" in f or "day=3" in f or "day=4" in f} <= files() and not any("day=0" in f for f in files()) and not os.path.exists(f"{path}.staged")
    assert deletion.rewrite(spark, path, "run_id", lost, "day") == (0, 0)


def test_deletion_reaches_children(spark):
    runs = spark.createDataFrame([(1,), (2,), (3,)], "run_id bigint")
    calls = spark.createDataFrame([(10, 1), (11, 1), (12, 2), (13, None)], "call_id bigint, run_id bigint")
    parts = spark.createDataFrame([(100, 10), (101, 12), (102, 11)], "part_id bigint, call_id bigint")
    children = [deletion.Child("calls", "run_id", "runs", "call_id"), deletion.Child("parts", "call_id", "calls", "part_id")]
    lost = deletion.cascade({"runs": runs, "calls": calls, "parts": parts}, "runs", "run_id", spark.createDataFrame([(1,), (9,)], "run_id bigint"), children)
    assert {k: sorted(r[0] for r in v.collect()) for k, v in lost.items()} == {"runs": [1], "calls": [10, 11], "parts": [100, 102]}


def test_delete_markers(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, None), ("b", 1, "y"), ("c", 1, None), ("c", 3, "z"), ("b", 2, "w")], "name string, at int, value string")
    got = {r["name"]: r["value"] for r in deletion.current(log, "name", ["at"], F.col("value").isNull()).collect()}
    assert got == {"b": "w", "c": "z"}


def test_migrations_are_ordered_recorded_and_checked(spark, tmp_path):
    path, made = str(tmp_path / "db"), []

    def first(before):
        made.append("first")
        return {"runs": spark.createDataFrame([(1, "a")], "run_id bigint, note string")}

    def second(before):
        made.append("second")
        return {"runs": before["runs"].withColumn("score", F.lit(0.5))}

    one = schemas.Migration("001_initial", first, {"runs": "run_id bigint, note string"})
    two = schemas.Migration("002_scores", second, {"runs": "run_id bigint, note string, score double"})
    assert schemas.migrate(spark, path, [one]) == [1] and schemas.migrate(spark, path, [two, one]) == [2] and schemas.migrate(spark, path, [one, two]) == []
    assert made == ["first", "second"] and schemas.latest(spark, path, "runs").first()["score"] == 0.5
    with pytest.raises(schemas.MigrationFailed, match="twice"):
        schemas.ordered([one, schemas.Migration("001_again", first, {})])
    with pytest.raises(schemas.MigrationFailed, match="name"):
        schemas.ordered([schemas.Migration("3-wrong", first, {})])
    with pytest.raises(schemas.MigrationFailed, match="note"):
        schemas.migrate(spark, path, [one, two, schemas.Migration("003_drop", lambda b: {"runs": b["runs"].drop("note")}, {"runs": "run_id bigint, note string, score double"})])
    assert schemas.applied_versions(spark, path) == [1, 2]


def test_schema_trees(spark):
    want, have = (StructType.fromDDL(d) for d in ("a int, b array<struct<x: int, y: string>>, m map<string, int>, z double", "z double, a bigint, b array<struct<x: int>>, m map<string, string>, n string"))
    assert schemas.differences(want, have) == [("a", "type", "int", "bigint"), ("b[].y", "missing", "string", None), ("m{value}", "type", "int", "string"), ("n", "unexpected", None, "string")]
    assert schemas.differences(want, want) == []


# -- paths, flips, cases


def test_simple_paths(spark, data):
    onward = {a: sorted(t for x, t in rules.EDGE_ROWS if x == a) for a in {a for a, _ in rules.EDGE_ROWS}}
    want = set()

    def walk(path):
        for nxt in onward.get(path[-1], []):
            if nxt not in path:
                want.add(">".join([*path, nxt]))
                walk([*path, nxt])

    walk(["created"])
    got = rules.simple_paths(spark, data).collect()
    assert {r["path"] for r in got} == want and len(got) == len(want) and len(want) > 40


def test_flips_from_contingencies_are_those_of_pairs(spark):
    r = random.Random(5)
    outcomes = [(label, False, base, run, r.choice(["a", "b", None]), r.choice([None, 0.25, 0.5, 0.75])) for label in "xy" for base in range(6) for run in range(r.randrange(1, 7))]
    states = [(label, c, base, run, k, r.choice("pq")) for label, c, base, run, *_ in outcomes for k in ("k1", "k2", "k3") if r.random() < 0.6]
    frame = spark.createDataFrame(outcomes, "label string, control boolean, base int, run int, band string, score double")
    held = spark.createDataFrame(states, "label string, control boolean, base int, run int, criterion string, state string")
    bands = {x["label"]: (x["n"], x["k"]) for x in flips.band_flips(frame).collect()}
    criteria = {x["label"]: (x["n"], x["k"]) for x in flips.criterion_flips(frame, held).collect()}
    deltas = {x["label"]: (x["n"], round(x["total"], 9), x["largest"]) for x in flips.score_deltas(frame).collect()}
    for label in "xy":
        mine = [o for o in outcomes if o[0] == label]
        pairs = [(a, b) for i, a in enumerate(mine) for b in mine[i + 1 :] if a[2] == b[2]]
        assert bands[label] == (len(pairs), sum(a[4] != b[4] for a, b in pairs))
        of = lambda o: {s[4]: s[5] for s in states if s[0] == o[0] and s[2] == o[2] and s[3] == o[3]}
        keys = [(of(a), of(b)) for a, b in pairs]
        assert criteria[label] == (sum(len({*x, *y}) for x, y in keys), sum(x.get(k) != y.get(k) for x, y in keys for k in {*x, *y}))
        moved = [abs(a[5] - b[5]) for a, b in pairs if a[5] is not None and b[5] is not None]
        assert deltas[label] == (len(moved), round(sum(moved), 9), max(moved))


def test_nearest_cards_of_a_bounded_corpus(spark, data):
    """A small corpus and few queries a task, against plain ranking; a null label matches nothing."""
    import numpy as np

    every = evidence.cards(spark, data)
    corpus = evidence.newest_cards(every, 20)
    rows = [r.asDict() for r in every.collect()]
    newest = {}
    for r in rows:
        newest.setdefault(r["label"], []).append(r)
    newest = {k: sorted(v, key=lambda r: (-r["day"], r["vec_id"]))[:20] for k, v in newest.items()}
    assert sorted(r["vec_id"] for r in corpus.collect()) == sorted(r["vec_id"] for v in newest.values() for r in v)
    asked = every.where("vec_id % 3 = 0").select(F.col("vec_id").alias("query_id"), "label", "major", F.col("e").alias("q"))
    for diverse in (False, True):
        got = {}
        for r in evidence.matched(asked, corpus, 2, diverse).collect():
            got.setdefault(r["query_id"], []).append((r["nth"], r["vec_id"]))
        changed = 0
        for q in rows:
            if q["vec_id"] % 3:
                continue
            able = [c for c in newest[q["label"]] if c["major"] == q["major"] and c["vec_id"] != q["vec_id"] and c["day"] >= evidence.AS_OF_DAY - evidence.STALE_DAYS]
            scored = sorted(((-round(float(np.dot(q["e"], c["e"])), 6), c["vec_id"], c["band"]) for c in able), key=lambda x: x[:2])
            scored = [s for s in scored if -s[0] >= evidence.LEAST]
            chosen = scored[:2]
            other = [s for s in scored[2:] if s[2] != chosen[0][2]] if len(chosen) == 2 and chosen[0][2] == chosen[1][2] else []
            if diverse and other:
                chosen, changed = [chosen[0], other[0]], changed + 1
            assert sorted(got.get(q["vec_id"], [])) == [(n, c[1]) for n, c in enumerate(chosen, 1)]
        assert not diverse or changed


def test_snapshot_scans_each_table_once(spark, data):
    from proofmill.plans import snapshot

    plan = snapshot.snapshot(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(f"{t}.parquet") for t in ("orders", "lineitem", "documents")] == [1, 1, 1]


def test_hashed_vectors_against_plain_ones(spark, data):
    import hashlib
    import math
    import re

    texts = {r["doc_id"]: r["text"] for r in read_table(spark, data, "documents").collect()}
    for r in evidence.hashed_vectors(spark, data).collect():
        v = [0.0] * 256
        for word in re.findall(r"[a-z0-9+#.]{2,}", (texts[r["doc_id"]] or "").lower()):
            if word not in evidence.COMMON_WORDS:
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % 256] += 1 if h >> 63 else -1
        norm = math.sqrt(sum(x * x for x in v))
        if r["vector"] is None or not norm:
            assert not any(v) or r["vector"] is not None
            continue
        assert all(abs(a - b / norm) < 1e-6 for a, b in zip(r["vector"], v))
