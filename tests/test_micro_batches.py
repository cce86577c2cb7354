"""Streams over several micro-batches, with restarts, against their batch twins."""

import bisect
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veridoc.sources.shared import shared_dir
from veridoc.streaming import events as ev
from veridoc.streaming.late import RANK_ERROR, WindowLog, duration_sketches, metric_partials, metrics_of, quantile, rolled_up
from veridoc.streaming.ordered import redact_unordered, state_session
from veridoc.streaming.runner import arriving, resume, stream_of

T0 = datetime(2024, 5, 1)
NAMES = ("email", "telefono", "cedula")
DELTAS = "response_id long, sequence_number long, type string, delta string, ts timestamp"


def answers(rng, n):
    out = {}
    for i in range(n):
        words = [rng.choice(["see", "call 55 1234 5678", "mail a.b@c.org", "id 12345678", "the valve", "nothing\n"]) for _ in range(rng.randint(0, 12))]
        out[i] = " ".join(words)
    return out


def events_of(rng, texts, lost=()):
    """Deltas of one to nine characters and a done event, minutes apart at most."""
    rows = []
    for i, text in texts.items():
        at, n = 0, 0
        while at < len(text):
            step = rng.randint(1, 9)
            if (i, n) not in lost:
                rows.append((i, n, "output_text.delta", text[at : at + step], T0 + timedelta(seconds=10 * i + n)))
            at, n = at + step, n + 1
        rows.append((i, n, "output_text.done", None, T0 + timedelta(seconds=10 * i + n)))
    return rows


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["response_id"], r["part"])):
        out.setdefault(r["response_id"], []).append((r["part"], r["text"]))
    assert all([p for p, _ in v] == list(range(len(v))) for v in out.values())
    return {k: "".join(t for _, t in v) for k, v in out.items()}


def test_shuffled_deltas_equal_masked_texts_after_a_restart(spark):
    rng = random.Random(11)
    texts = answers(rng, 40)
    rows = events_of(rng, texts)
    rows += rng.sample(rows, 60)  # at-least-once delivery
    rng.shuffle(rows)
    table = spark.createDataFrame([(*r, k % 6) for k, r in enumerate(rows)], DELTAS + ", b int")
    session = state_session(spark)
    first = arriving(table.filter("b < 3").drop("b"), "deltas", 3, F.pmod(F.xxhash64("response_id", "sequence_number", "ts"), F.lit(3)))
    out = shared_dir(spark, "redacted")
    stream = stream_of(session, first, DELTAS)
    resume(redact_unordered(stream, NAMES), out)
    early = joined(spark.read.parquet(out).collect())
    # more files arrive, and the stream goes on from its checkpoint
    for k in range(3, 6):
        table.filter(F.col("b") == k).drop("b").coalesce(1).write.mode("append").parquet(first)
    resume(redact_unordered(stream_of(session, first, DELTAS), NAMES), out)
    got = joined(spark.read.parquet(out).collect())
    want = {i: ev.mask_text(t, NAMES) for i, t in texts.items()}
    assert got == want
    assert any(0 < len(early.get(i, "")) < len(want[i]) for i in want)


def test_lost_deltas_are_waited_for_and_then_left_out(spark):
    rng = random.Random(12)
    texts = {i: f"part one of {i}, part two of it, part three of it" for i in range(6)}
    lost = {(1, 2), (3, 0), (4, 1)}
    rows = events_of(rng, texts, lost)
    rows += [(5, None, "output_text.delta", "no number", T0), (None, 0, "output_text.delta", "no id", T0)]
    closing = [[(90 + k, 0, "output_text.done", None, T0 + timedelta(hours=k + 1))] for k in range(2)]
    shuffled = rows[:]
    rng.shuffle(shuffled)
    batches = [shuffled[::2], shuffled[1::2], *closing]
    table = spark.createDataFrame([(*r, k) for k, b in enumerate(batches) for r in b], DELTAS + ", b int")
    path = arriving(table, "deltas", len(batches), F.col("b"))
    out = shared_dir(spark, "redacted")
    resume(redact_unordered(stream_of(state_session(spark), path, DELTAS), (), gap_s=600), out)
    got = joined(spark.read.parquet(out).collect())
    kept = {}
    for i, n, _, d, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: r[:2]):
        kept[i] = kept.get(i, "") + (d or "")
    assert {i: got.get(i) for i in texts} == kept


TELEMETRY = "ts timestamp, event string, ttft_ms double, chunks int, latency_ms int, grounded boolean"


def telemetry_batches(rng, n):
    rows = []
    for b in range(n):
        for _ in range(60):
            at = T0 + timedelta(minutes=30 * b + rng.randint(0, 20)) - (timedelta(minutes=rng.randint(5, 90)) if rng.random() < 0.3 else timedelta(0))
            rows.append((at, rng.choice(["response.completed", "response.failed", "span.retrieval"]), rng.random() * 1000, rng.randint(0, 9), rng.randint(1, 500), rng.random() < 0.9, b))
    return [*rows, (None, "response.failed", 1.0, 1, 1, True, 0)]


def naive_split(rows, n):
    """Windows that a row ended too early for, by the latest row of the batches before."""
    late, on_time, latest = [], [], None
    for b in range(n):
        mine = [r for r in rows if r[6] == b and r[0] is not None]
        for r in mine:
            end = r[0] - timedelta(seconds=(r[0] - T0).total_seconds() % 300) + timedelta(minutes=5)
            (late if latest is not None and end <= latest - timedelta(minutes=10) else on_time).append(r)
        latest = max([r[0] for r in mine] + ([latest] if latest else []))
    return late, on_time, latest


def test_late_rows_and_windows_add_up_to_the_input(spark):
    rows = telemetry_batches(random.Random(13), 6)
    late, on_time, latest = naive_split(rows, 6)
    assert len(late) > 10
    table = spark.createDataFrame(rows, TELEMETRY + ", b int")
    path = arriving(table.filter("b < 4"), "late-source", 4, F.col("b"))
    log = WindowLog(spark, shared_dir(spark, "late"))
    log.run(stream_of(spark, path, TELEMETRY))
    for b in (4, 5):
        table.filter(F.col("b") == b).drop("b").coalesce(1).write.mode("append").parquet(path)
    log.run(stream_of(spark, path, TELEMETRY))  # goes on from the checkpoint
    log.run(stream_of(spark, path, TELEMETRY))  # nothing new
    got = log.late(spark, TELEMETRY).select("ts", "event", "epoch").collect()
    assert sorted(tuple(r) for r in got) == sorted((r[0], r[1], r[6]) for r in late)
    every = log.windows(spark, closed=False)
    exact = {r["period"]: r for r in ev.metric_windows(spark.createDataFrame([r[:6] for r in on_time], TELEMETRY)).collect()}
    held = {r["period"]: r for r in every.collect()}
    assert held.keys() == exact.keys() and sum(r["n"] for r in held.values()) + len(late) == len(rows) - 1
    for p, r in held.items():
        assert all(r[c] == exact[p][c] for c in ("n", "n_errors", "n_ungrounded")) and r["chunks_avg"] == pytest.approx(exact[p]["chunks_avg"])
    closed = {r["period"] for r in log.windows(spark).collect()}
    assert closed == {p for p in held if p + timedelta(minutes=5) <= latest - timedelta(minutes=10)} and closed < held.keys()


def test_repeated_batch_replaces_what_it_wrote(spark):
    log = WindowLog(spark, shared_dir(spark, "late"))
    batch = lambda *minutes: spark.createDataFrame([(T0 + timedelta(minutes=m), "e", None, None, None, None) for m in minutes], TELEMETRY)
    log(batch(0, 60), 0)
    log(batch(10, 70), 1)
    log(batch(10, 70), 1)
    log(batch(), 2)
    log(batch(56, 58), 3)
    assert log.late(spark, TELEMETRY).count() == 3
    assert log.windows(spark, closed=False).agg(F.sum("n")).first()[0] == 3
    assert {r["ttft_p50"] for r in log.windows(spark, closed=False).collect()} == {None}


def test_sketches_merge_within_their_error(spark):
    rng = random.Random(16)
    values = [rng.lognormvariate(3, 1) for _ in range(60_000)]
    rows = [(T0 + timedelta(seconds=i % 3600), "response.completed", v, None, None, True) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, TELEMETRY).repartition(8)
    parts = metric_partials(table)
    assert parts.count() == 12
    hour = metrics_of(rolled_up(parts.unionByName(parts), "1 hour")).collect()  # each twice: same ranks
    assert len(hour) == 1 and hour[0]["n"] == 120_000
    ordered = sorted(values)
    for name, p in (("ttft_p50", 0.5), ("ttft_p95", 0.95)):
        assert abs(bisect.bisect_left(ordered, hour[0][name]) / len(ordered) - p) <= RANK_ERROR
    spans = table.withColumn("event", F.lit("span.retrieval")).withColumn("latency_ms", F.col("ttft_ms").cast("int")).withColumn("model", F.lit("m"))
    one = duration_sketches(spans).withColumn("p95", quantile(F.col("latency"), 0.95)).first()
    ranks = sorted(int(v) for v in values)
    assert bisect.bisect_left(ranks, one["p95"]) / len(ranks) - RANK_ERROR <= 0.95 <= bisect.bisect_right(ranks, one["p95"]) / len(ranks) + RANK_ERROR


def lifecycle_rows(spark):
    rng = random.Random(14)
    accepted, ended = [], []
    for i in range(60):
        at = T0 + timedelta(minutes=2 * i)
        accepted.append((f"r{i}", at))
        if rng.random() < 0.6:
            ended.append((f"r{i}", at + timedelta(seconds=rng.randint(0, 150)), "response.completed"))
    return spark.createDataFrame(accepted, "request_id string, ts timestamp"), spark.createDataFrame(ended, "request_id string, ts timestamp, event string")


def test_lifecycle_stream_equals_its_batch(spark):
    accepted, ended = lifecycle_rows(spark)
    want = {tuple(r) for r in ev.request_lifecycle(accepted, ended).select("request_id", "outcome").collect()}
    assert any(o is None for _, o in want) and any(o for _, o in want)
    close = T0 + timedelta(days=1)
    half = F.floor((F.unix_seconds("ts") - F.lit(int(T0.timestamp()))) / 1800)
    number = F.when(half < 4, half).otherwise(4).cast("int")
    a = arriving(accepted.unionByName(spark.createDataFrame([("end", close)], accepted.schema)), "accepted", 5, F.when(F.col("request_id") == "end", 4).otherwise(F.least(number, F.lit(3))))
    e = arriving(ended.unionByName(spark.createDataFrame([("none", close, "x")], ended.schema)), "ended", 5, F.when(F.col("request_id") == "none", 4).otherwise(F.least(number, F.lit(3))))
    out = shared_dir(spark, "lifecycle")
    both = lambda: ev.request_lifecycle(stream_of(spark, a, accepted.schema), stream_of(spark, e, ended.schema))
    resume(both(), out)
    resume(both(), out)  # a restart has nothing left to tell
    got = [tuple(r) for r in spark.read.parquet(out).select("request_id", "outcome").collect()]
    assert len(got) == len(set(got)) and {g for g in got if g[0] != "end"} == want


def test_deduplicated_stream_equals_its_batch(spark):
    rng = random.Random(15)
    rows = [(i % 20, i // 20, T0 + timedelta(seconds=i), k) for i in range(200) for k in sorted({rng.randint(0, 3) for _ in range(3)})]
    table = spark.createDataFrame(rows, "response_id long, sequence_number long, ts timestamp, b int")
    path = arriving(table, "log", 4, F.col("b"))
    out = shared_dir(spark, "distinct")
    resume(ev.dedup_responses(stream_of(spark, path, table.drop("b").schema)), out)
    assert spark.read.parquet(out).count() == ev.dedup_responses(table).count() == 200
    assert pytest.approx(0) == spark.read.parquet(out).select("response_id", "sequence_number").exceptAll(table.select("response_id", "sequence_number").distinct()).count()
