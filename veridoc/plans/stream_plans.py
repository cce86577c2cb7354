"""Queries over telemetry and response events, as batches and as streams of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.functions.text import is_denial, is_grounded, mask_identifiers, text_fingerprint
from veridoc.operators import chunking
from veridoc.plans.inputs import documents, table
from veridoc.plans.policies import PUBLIC
from veridoc.plans.text_plans import SQL as TEXT_SQL
from veridoc.plans.text_plans import sql_denial
from veridoc.sources.shared import shared_dir
from veridoc.streaming import events as ev
from veridoc.streaming.late import RANK_ERROR, WindowLog
from veridoc.streaming.ordered import redact_unordered, state_session
from veridoc.streaming.runner import arriving, run_available, stream_of

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: events as telemetry: errors fail, clicks and views complete, purchases retrieve, sign-ups infer.
TELEMETRY = """(select ts, case event_type when 'error' then 'response.failed' when 'purchase' then 'span.retrieval' when 'signup' then 'span.inference' else 'response.completed' end as event,
 'm' || (user_id % 3) as model, 'p' || (user_id % 2) as profile, value * 100 as ttft_ms, cast(event_id % 9 as integer) as chunks, cast(floor(value * 10) as integer) as latency_ms, event_id % 17 <> 0 as grounded, event_id % 1000 as input_tokens, event_id % 300 as output_tokens, user_id, event_id from events)"""


def telemetry(spark, sf):
    e = F.col("event_type")
    event = F.when(e == "error", "response.failed").when(e == "purchase", "span.retrieval").when(e == "signup", "span.inference").otherwise("response.completed")
    return table(spark, sf, "events").select(
        F.col("ts").cast("timestamp").alias("ts"),
        event.alias("event"),
        F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
        F.concat(F.lit("p"), (F.col("user_id") % 2).cast("string")).alias("profile"),
        (F.col("value") * 100).alias("ttft_ms"),
        (F.col("event_id") % 9).cast("int").alias("chunks"),
        F.floor(F.col("value") * 10).cast("int").alias("latency_ms"),
        (F.col("event_id") % 17 != 0).alias("grounded"),
        (F.col("event_id") % 1000).alias("input_tokens"),
        (F.col("event_id") % 300).alias("output_tokens"),
        "user_id",
        "event_id",
    )


METRICS = f"""(select time_bucket(interval '5 minutes', ts) as period, count(*) as n, quantile_cont(ttft_ms, 0.5) filter (event = 'response.completed') as ttft_p50, quantile_cont(ttft_ms, 0.95) filter (event = 'response.completed') as ttft_p95,
 avg(chunks) filter (event = 'span.retrieval') as chunks_avg, quantile_cont(latency_ms::double, 0.95) filter (event = 'span.retrieval') as latency_p95, count(*) filter (event = 'response.failed') as n_errors, count(*) filter (event = 'response.completed' and not grounded) as n_ungrounded from {TELEMETRY} group by 1)"""


@query("metric_windows", f"select epoch(period)::bigint as period_s, n, round(ttft_p50, 6) as ttft_p50, round(ttft_p95, 6) as ttft_p95, chunks_avg, latency_p95, n_errors, n_ungrounded from {METRICS}")
def metric_windows(spark, sf):
    m = ev.metric_windows(telemetry(spark, sf))
    return m.select(F.unix_seconds("period").alias("period_s"), "n", F.round("ttft_p50", 6).alias("ttft_p50"), F.round("ttft_p95", 6).alias("ttft_p95"), "chunks_avg", "latency_p95", "n_errors", "n_ungrounded")


@query("alarm_ttft", f"select epoch(a.period)::bigint as period_s, round(a.ttft_p95, 6) as ttft_p95 from {METRICS} a join {METRICS} b on a.period = b.period + interval '5 minutes' where a.ttft_p95 > 2000 and b.ttft_p95 > 2000")
def alarm_ttft(spark, sf):
    found = ev.alarm_ttft(ev.metric_windows(telemetry(spark, sf)), 2000.0)
    return found.select(F.unix_seconds("period").alias("period_s"), F.round("ttft_p95", 6).alias("ttft_p95"))


@query("alarm_grounding", f"select epoch(period)::bigint as period_s, n_ungrounded from {METRICS} where n_ungrounded > 0")
def alarm_grounding(spark, sf):
    return ev.alarm_grounding(ev.metric_windows(telemetry(spark, sf))).select(F.unix_seconds("period").alias("period_s"), "n_ungrounded")


@query("usage_rollup", f"select model, profile, count(*) as n, cast(sum(input_tokens) as bigint) as input_tokens, cast(sum(output_tokens) as bigint) as output_tokens, cast(sum(input_tokens + output_tokens) as bigint) as total_tokens from {TELEMETRY} where event = 'response.completed' group by all")
def usage_rollup(spark, sf):
    return ev.usage_rollup(telemetry(spark, sf))


@query("span_durations", f"select event, model, count(*) as n, quantile_cont(latency_ms::double, 0.5) as p50, quantile_cont(latency_ms::double, 0.95) as p95 from {TELEMETRY} where event in ('span.retrieval', 'span.inference') group by all")
def span_durations(spark, sf):
    return ev.span_durations(telemetry(spark, sf))


#: conversations as responses: turns in sequence, text as deltas; conversations divisible by 5 end in a failure.
RESPONSES = "(select conv_id as response_id, turn as sequence_number, case when turn = max(turn) over (partition by conv_id) then case when conv_id % 5 = 0 then 'response.failed' when conv_id % 5 = 1 then 'output_text.done' else 'response.completed' end else 'output_text.delta' end as type, text as delta from conversations where not (conv_id % 7 = 0 and turn = 1))"


def responses(spark, sf):
    from pyspark.sql import Window

    c = F.col("conv_id")
    rows = table(spark, sf, "conversations").filter(~((c % 7 == 0) & (F.col("turn") == 1)))
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    kind = F.when(last, F.when(c % 5 == 0, "response.failed").when(c % 5 == 1, "output_text.done").otherwise("response.completed")).otherwise("output_text.delta")
    return rows.select(c.alias("response_id"), F.col("turn").alias("sequence_number"), kind.alias("type"), F.col("text").alias("delta"))


@query("stream_rebuild", f"select response_id, md5(string_agg(delta, '' order by sequence_number)) as text_md5, count(*) as n from {RESPONSES} group by response_id")
def stream_rebuild(spark, sf):
    return ev.stream_rebuild(responses(spark, sf)).select("response_id", F.md5("text").alias("text_md5"), "n")


@query(
    "sequence_audit",
    f"""select response_id, count(*) as n, min(sequence_number) = 0 as starts_at_zero, count(*) = count(distinct sequence_number) and max(sequence_number) - min(sequence_number) + 1 = count(*) as gapless,
    arg_max(type, sequence_number) in ('response.completed', 'response.failed') as terminal, count(*) filter (type = 'response.completed') > 0 and count(*) filter (type = 'response.failed') > 0 as contradictory from {RESPONSES} group by response_id""",
)
def sequence_audit(spark, sf):
    return ev.sequence_audit(responses(spark, sf))


@query("dedup_responses", "select conv_id as response_id, count(*) as n from conversations group by 1")
def dedup_responses(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("response_id"), F.col("turn").alias("sequence_number"))
    return ev.dedup_responses(rows.unionAll(rows)).groupBy("response_id").agg(F.count("*").alias("n"))


@query("request_lifecycle", "select a.event_id as request_id, e.event_type as outcome from events a left join (select * from events where event_type in ('error', 'purchase')) e on e.user_id = a.user_id and e.event_id = a.event_id + 1 and e.ts between a.ts and a.ts + interval 110 seconds where a.event_type = 'view'")
def request_lifecycle(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    accepted = e.filter("event_type = 'view'").select(F.concat_ws("-", "user_id", "event_id").alias("request_id"), "ts", F.col("event_id").alias("id"))
    ended = e.filter("event_type in ('error', 'purchase')").select(F.concat_ws("-", "user_id", (F.col("event_id") - 1).cast("string")).alias("request_id"), "ts", F.col("event_type").alias("event"))
    return ev.request_lifecycle(accepted, ended).select(F.split_part("request_id", F.lit("-"), F.lit(2)).cast("long").alias("request_id"), "outcome")


@query("rate_limit_audit")
def rate_limit_audit(spark, sf):
    # each event is a request of its user; at about two a day, a bucket of two that a day refills runs dry
    requests = table(spark, sf, "events").select(F.col("user_id").alias("client_key"), F.col("ts").cast("timestamp").alias("ts"))
    return ev.rate_limit_audit(requests, limit=2.0, refill_s=86_400.0)


def _as_stream(spark, rows, name: str):
    path = shared_dir(spark, name)
    rows.write.parquet(path)
    return spark.readStream.schema(rows.schema).parquet(path)


@query("metric_windows_stream")
def metric_windows_stream(spark, sf):
    """All windows of the stream: a closing row moves the watermark behind the last one; its own window, which no
    row of the stream is in, stays open."""
    rows = telemetry(spark, sf)
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 1 HOUR")).alias("ts"))
    end = end.select(*[F.col("ts") if f.name == "ts" else F.lit("stream.end").alias("event") if f.name == "event" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    return run_available(ev.metric_windows(_as_stream(spark, rows.unionByName(end), "telemetry")), "metrics")


@query("stream_answers", f"select response_id, md5(string_agg(delta, '' order by sequence_number)) as text_md5 from {RESPONSES} group by response_id")
def stream_answers(spark, sf):
    """Deltas through the redactor with an empty policy: pieces join to the whole answers."""
    return _answers(responses(spark, sf)).select("response_id", F.md5("text").alias("text_md5"))


#: responses of which some name a document or decline at their end.
ENDINGS = f"case response_id % 4 when 1 then ' [doc-1]' when 2 then ' {PUBLIC.decline}' when 3 then ' [doc-3]' else '' end"


@query(
    "finished_answers",
    f"""select response_id, md5(a) as text_md5, left(sha256(a), 16) as fingerprint, {sql_denial('a')} as is_denial, contains(lower(a), '{PUBLIC.decline.lower().rstrip('.')}') or contains(a, '[doc-1]') or contains(a, '[doc-2]') as is_grounded
    from (select response_id, coalesce(string_agg(delta, '' order by sequence_number), '') || {ENDINGS} as a from {RESPONSES} group by response_id)""",
)
def finished_answers(spark, sf):
    """stream_answers with what is judged of each finished answer: fingerprint, denial and grounding."""
    k = F.col("response_id") % 4
    ending = F.when(k == 1, " [doc-1]").when(k == 2, f" {PUBLIC.decline}").when(k == 3, " [doc-3]").otherwise("")
    text = F.col("text")
    grounded = is_grounded(text, F.array(F.lit("doc-1"), F.lit("doc-2")), PUBLIC.decline)
    return _answers(responses(spark, sf), ending).select("response_id", F.md5("text").alias("text_md5"), text_fingerprint(text).alias("fingerprint"), is_denial(text, PUBLIC.decline).alias("is_denial"), grounded.alias("is_grounded"))


def _answers(rows, ending=None):
    """(response_id, text) of responses that a done event ends, streamed with an empty policy."""
    ends = rows.groupBy("response_id").agg((F.max("sequence_number") + 1).alias("sequence_number"))
    ends = ends.select("response_id", "sequence_number", F.lit("output_text.done").alias("type"), (F.lit(None).cast("string") if ending is None else ending).alias("delta"))
    return _joined(run_available(ev.redact_stream(_as_stream(rows.sparkSession, rows.unionByName(ends), "deltas"), ()), "answers"))


@query("redact_stream")
def redact_stream(spark, sf):
    """Documents as streams of deltas of 64 characters; checked against masking the whole texts; a null text counts as an empty one."""
    docs = table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    # a text is cut in one pass; taking each piece from the whole text would pass over it for each
    full = F.regexp_extract_all("text", F.lit("(?s).{1,64}"), F.lit(0))
    pieces = F.when(F.length("text") % 64 == 0, F.array_append(full, F.lit(""))).otherwise(full)
    cut = docs.select(F.col("doc_id").alias("response_id"), pieces.alias("pieces")).select("response_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("sequence_number", "delta"))
    kind = F.when(F.col("sequence_number") == F.col("n") - 1, "output_text.done").otherwise("output_text.delta")
    rows = cut.select("response_id", "sequence_number", kind.alias("type"), "delta")
    names = ("email", "telefono", "cedula")
    parts = run_available(ev.redact_stream(_as_stream(spark, rows, "document-deltas"), names), "redacted")
    whole = docs.select(F.col("doc_id").alias("response_id"), F.md5(mask_identifiers(F.col("text"), names)).alias("whole_md5"))
    joined = _joined(parts).select("response_id", F.md5("text").alias("text_md5"))
    return whole.join(joined, "response_id", "left").select("response_id", "text_md5", F.equal_null("text_md5", "whole_md5").alias("same"))


@query("incremental_prep")
def incremental_prep(spark, sf):
    """Documents become chunks as they arrive; only a manifest would need them all."""
    docs = documents(spark, sf).select("doc_id", "stem", "text")
    chunked = chunking.chunk_documents(_as_stream(spark, docs, "arriving"), PUBLIC.chunking)
    return run_available(chunked, "chunks").select("doc_id", "document_id", "chunk_index", "chunk_total", "chunk_text")


def _joined(parts):
    texts = F.transform(F.sort_array(F.collect_list(F.struct("part", "text"))), lambda x: x["text"])
    return parts.groupBy("response_id").agg(F.array_join(texts, "").alias("text"))


#: Files of a micro-batch at most, for its tasks to share.
MOST_FILES = 64


def _shuffled(deltas, batches: int = 4):
    """Deltas (response_id, sequence_number, type, delta) as a stream of batches that hold any of them, one in seven
    twice; two later rows of another response let the wait for missing ones end."""
    spark = deltas.sparkSession
    keys = ("response_id", "sequence_number")
    rows = deltas.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("sequence_number") % 60))
    once = rows.withColumn("b", F.pmod(F.xxhash64(*keys), F.lit(batches)).cast("int"))
    again = once.filter(F.pmod(F.xxhash64(*keys, F.lit(1)), F.lit(7)) == 0).withColumn("b", F.lit(batches - 1))
    closing = spark.range(2).select(F.lit(-1).cast(rows.schema["response_id"].dataType).alias("response_id"), F.lit(0).alias("sequence_number"), F.lit("output_text.done").alias("type"), F.lit(None).cast("string").alias("delta"), F.timestamp_seconds(F.lit(1_700_086_400) + F.col("id") * 86_400).alias("ts"), (F.col("id") + batches).cast("int").alias("b"))
    files = max(1, min(MOST_FILES, deltas.rdd.getNumPartitions()))
    path = arriving(once.unionByName(again).unionByName(closing.withColumn("sequence_number", F.col("sequence_number").cast(rows.schema["sequence_number"].dataType))), "shuffled", batches + 2, F.col("b"), files)
    return stream_of(state_session(spark), path, rows.schema, files)


@query("ordered_answers", f"select response_id, md5(string_agg(delta, '' order by sequence_number)) as text_md5 from {RESPONSES} group by response_id")
def ordered_answers(spark, sf):
    """stream_answers of deltas that come in any order over several micro-batches, some twice and some never."""
    parts = run_available(redact_unordered(_shuffled(responses(spark, sf)), ()), "ordered", spark=spark)
    return _joined(parts.filter("response_id >= 0")).select("response_id", F.md5("text").alias("text_md5"))


@query("redact_unordered", TEXT_SQL["mask_emails"])
def redact_unordered_documents(spark, sf):
    """Documents as deltas of 512 characters that come in any order over several micro-batches, masked as they come."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    # a text is cut in one pass; a null one, or one of full pieces only, ends with an empty piece
    full = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("(?s).{1,512}"), F.lit(0))
    pieces = F.when(F.length(F.coalesce("text", F.lit(""))) % 512 == 0, F.array_append(full, F.lit(""))).otherwise(full)
    cut = docs.select(F.col("doc_id").alias("response_id"), pieces.alias("pieces")).select("response_id", F.size("pieces").alias("n"), F.posexplode("pieces").alias("sequence_number", "delta"))
    rows = cut.select("response_id", "sequence_number", F.when(F.col("sequence_number") == F.col("n") - 1, "output_text.done").otherwise("output_text.delta").alias("type"), "delta")
    parts = run_available(redact_unordered(_shuffled(rows), ("email",)), "masked", spark=spark)
    joined = _joined(parts.filter("response_id >= 0")).select(F.col("response_id").alias("doc_id"), F.md5("text").alias("masked_md5"))
    return docs.filter("text is not null").select("doc_id").join(joined, "doc_id").unionByName(docs.filter("text is null").select("doc_id", F.lit(None).cast("string").alias("masked_md5")))


def _stretch(rows, n: int):
    """Which of n equal stretches of time a row of rows is in, and the time of the last row."""
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    low, high = low or 0, high or 0
    return F.least(F.floor((F.unix_micros("ts") - F.lit(low)) * n / F.lit(max(high - low, 1))), F.lit(n - 1)).cast("int"), F.timestamp_micros(F.lit(high))


@query("lifecycle_stream", SQL["request_lifecycle"])
def lifecycle_stream(spark, sf):
    """request_lifecycle as two streams in several micro-batches; lost requests come out as the watermark passes them."""
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    quarter, last = _stretch(e, 4)
    close = spark.range(1).select(F.lit("end").alias("request_id"), (last + F.expr("interval 1 day")).alias("ts"), F.lit(None).cast("string").alias("event"))
    accepted = e.filter("event_type = 'view'").select(F.concat_ws("-", "user_id", "event_id").alias("request_id"), "ts", quarter.alias("b"))
    ended = e.filter("event_type in ('error', 'purchase')").select(F.concat_ws("-", "user_id", (F.col("event_id") - 1).cast("string")).alias("request_id"), "ts", F.col("event_type").alias("event"), quarter.alias("b"))
    a = arriving(accepted.unionByName(close.select("request_id", "ts", F.lit(4).alias("b"))), "accepted", 5, F.col("b"))
    b = arriving(ended.unionByName(close.select(F.lit("none").alias("request_id"), "ts", "event", F.lit(4).alias("b"))), "ended", 5, F.col("b"))
    joined = ev.request_lifecycle(stream_of(spark, a, "request_id string, ts timestamp"), stream_of(spark, b, "request_id string, ts timestamp, event string"))
    found = run_available(joined, "lifecycle").filter("request_id != 'end'")
    return found.select(F.split_part("request_id", F.lit("-"), F.lit(2)).cast("long").alias("request_id"), "outcome")


#: events in six batches by time, of which one row in ten comes two batches later; lateness is 10 minutes.
LATE = f"""(select *, time_bucket(interval '5 minutes', ts) as period from (select *, least(case when event_id % 10 = 0 then q + 2 else q end, 5) as b from (select *, cast(least(floor((epoch_us(ts) - min(epoch_us(ts)) over ()) * 6 / greatest(max(epoch_us(ts)) over () - min(epoch_us(ts)) over (), 1)), 5) as integer) as q from {TELEMETRY})))"""
BEFORE = f"(select b, max(m) over (order by b rows between unbounded preceding and 1 preceding) as latest from (select b, max(ts) as m from {LATE} group by b))"


@query(
    "late_rows",
    f"""select epoch(period)::bigint as period_s, count(*) filter (not late) as n, count(*) filter (late) as n_late, count(*) filter (not late and event = 'response.failed') as n_errors, true as p95_in_bounds
    from (select x.*, coalesce(period + interval '5 minutes' <= latest - interval '10 minutes', false) as late from {LATE} x join {BEFORE} using (b)) group by period""",
)
def late_rows(spark, sf):
    """Telemetry in six micro-batches, of which some rows come too late: rows in windows and late rows of each period,
    and whether each window's p95 of the time to the first token is within the sketch's rank error (or two rows)."""
    rows = telemetry(spark, sf).select("ts", "event", "ttft_ms", "chunks", "latency_ms", "grounded", "event_id")
    q, _ = _stretch(rows, 6)
    b = F.least(q + F.when(F.col("event_id") % 10 == 0, 2).otherwise(0), F.lit(5))
    numbered = rows.withColumn("b", b).drop("event_id")
    path = arriving(numbered, "telemetry-late", 6, F.col("b"))
    schema = "ts timestamp, event string, ttft_ms double, chunks int, latency_ms int, grounded boolean"
    log = WindowLog(spark, shared_dir(spark, "window-log"))
    log.run(stream_of(spark, path, schema))
    period = lambda df: df.withColumn("period", F.window("ts", ev.PERIOD)["start"])
    late = period(log.late(spark, schema)).groupBy("period").agg(F.count("*").alias("n_late"))
    windows = log.windows(spark, closed=False)
    on_time = period(spark.read.schema(schema).parquet(path)).filter("event = 'response.completed'").join(windows.select("period", "ttft_p95"), "period")
    ranks = on_time.groupBy("period").agg(F.count("*").alias("m"), F.count_if(F.col("ttft_ms") < F.col("ttft_p95")).alias("below"), F.count_if(F.col("ttft_ms") <= F.col("ttft_p95")).alias("upto")).join(late, "period", "left")
    # late rows are among the rows counted here, so they widen the bounds
    slack = F.col("m") * RANK_ERROR + 2 + F.coalesce("n_late", F.lit(0))
    inside = ranks.select("period", ((F.col("below") - slack <= 0.95 * F.col("m")) & (F.col("upto") + slack >= 0.95 * F.col("m"))).alias("inside"))
    out = windows.join(late, "period", "full_outer").join(inside, "period", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select(F.unix_seconds("period").alias("period_s"), count("n"), count("n_late"), count("n_errors"), F.coalesce("inside", F.lit(True)).alias("p95_in_bounds"))
