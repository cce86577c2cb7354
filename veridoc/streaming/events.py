"""Streams of telemetry and response deltas: metrics, alarms, rebuilt and redacted answers, audits.

Functions that take streams also take batches, so each has a batch twin.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veridoc.functions.text import HINTS, IDENTIFIERS, VISIBLE

PERIOD, LATENESS = "5 minutes", "10 minutes"
TTFT_LIMIT_MS, TTFT_PERIODS = 5000.0, 2
BUCKET, REFILL_S = 20.0, 60.0
FAILURES = ("response.failed", "request.failed")


def metric_windows(events: DataFrame, exact: bool | None = None) -> DataFrame:
    """Per five minutes of telemetry (ts, event, ttft_ms, chunks, latency_ms, grounded): percentiles, averages
    and counts. Streams drop rows later than LATENESS and estimate percentiles; batches take exact ones."""
    exact = not events.isStreaming if exact is None else exact
    q = (lambda c, p: F.percentile(c, p)) if exact else (lambda c, p: F.percentile_approx(c, p, 10_000))
    rows = events.withWatermark("ts", LATENESS) if events.isStreaming else events
    answered, retrieved = F.col("event") == "response.completed", F.col("event") == "span.retrieval"
    out = rows.groupBy(F.window("ts", PERIOD).alias("w")).agg(
        F.count("*").alias("n"),
        q(F.when(answered, F.col("ttft_ms")), 0.5).alias("ttft_p50"),
        q(F.when(answered, F.col("ttft_ms")), 0.95).alias("ttft_p95"),
        F.avg(F.when(retrieved, F.col("chunks"))).alias("chunks_avg"),
        q(F.when(retrieved, F.col("latency_ms")), 0.95).alias("latency_p95"),
        F.count_if(F.col("event").isin(*FAILURES)).alias("n_errors"),
        F.count_if(answered & ~F.col("grounded")).alias("n_ungrounded"),
    )
    return out.select(F.col("w.start").alias("period"), *[c for c in out.columns if c != "w"])


def alarm_ttft(metrics: DataFrame, limit_ms: float = TTFT_LIMIT_MS) -> DataFrame:
    """(period, ttft_p95) of periods at which the limit was passed in this and the period before; a period
    without rows does not breach."""
    # a join with the periods moved on by one, rather than a window over all time in one task
    breach = metrics.select("period", "ttft_p95", (F.coalesce(F.col("ttft_p95") > limit_ms, F.lit(False))).alias("breach"))
    again = breach.select((F.col("period") + F.expr("INTERVAL 5 MINUTES")).alias("period"), F.col("breach").alias("before"))
    return breach.join(again, "period", "left").filter(F.col("breach") & F.coalesce("before", F.lit(False))).select("period", "ttft_p95")


def alarm_grounding(metrics: DataFrame) -> DataFrame:
    return metrics.filter("n_ungrounded > 0").select("period", "n_ungrounded")


def dedup_responses(events: DataFrame) -> DataFrame:
    """One row for each response_id and sequence_number of an at-least-once log."""
    keys = ["response_id", "sequence_number"]
    return events.withWatermark("ts", LATENESS).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def stream_rebuild(deltas: DataFrame) -> DataFrame:
    """(response_id, text, n): deltas joined in sequence order."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("sequence_number", "delta"))), lambda x: F.coalesce(x["delta"], F.lit("")))
    return deltas.groupBy("response_id").agg(F.array_join(parts, "").alias("text"), F.count("*").alias("n"))


def sequence_audit(events: DataFrame) -> DataFrame:
    """(response_id, n, starts_at_zero, gapless, terminal, contradictory) of response events."""
    rows = events.groupBy("response_id").agg(
        F.count("*").alias("n"),
        F.count_distinct("sequence_number").alias("distinct_n"),
        F.min("sequence_number").alias("low"),
        F.max("sequence_number").alias("high"),
        F.max_by("type", "sequence_number").alias("last_type"),
        F.count_if(F.col("type") == "response.completed").alias("completed"),
        F.count_if(F.col("type") == "response.failed").alias("failed"),
    )
    return rows.select(
        "response_id",
        "n",
        (F.col("low") == 0).alias("starts_at_zero"),
        ((F.col("n") == F.col("distinct_n")) & (F.col("high") - F.col("low") + 1 == F.col("n"))).alias("gapless"),
        F.col("last_type").isin("response.completed", "response.failed").alias("terminal"),
        ((F.col("completed") > 0) & (F.col("failed") > 0)).alias("contradictory"),
    )


def usage_rollup(telemetry: DataFrame) -> DataFrame:
    done = telemetry.filter("event = 'response.completed'")
    return done.groupBy("model", "profile").agg(F.count("*").alias("n"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"))


def span_durations(telemetry: DataFrame, label: str = "model") -> DataFrame:
    spans = telemetry.filter("event in ('span.retrieval', 'span.inference')")
    return spans.groupBy("event", label).agg(F.count("*").alias("n"), F.percentile("latency_ms", 0.5).alias("p50"), F.percentile("latency_ms", 0.95).alias("p95"))


def request_lifecycle(accepted: DataFrame, ended: DataFrame, limit: str = "110 seconds") -> DataFrame:
    """(request_id, ts, outcome, took_s): each accepted request with its end within the limit; null: lost."""
    a, e = accepted.alias("a"), ended.alias("e")
    if accepted.isStreaming:
        a, e = accepted.withWatermark("ts", LATENESS).alias("a"), ended.withWatermark("ts", LATENESS).alias("e")
    on = F.expr(f"a.request_id = e.request_id and e.ts between a.ts and a.ts + interval {limit}")
    return a.join(e, on, "left_outer").select(F.col("a.request_id").alias("request_id"), F.col("a.ts").alias("ts"), F.col("e.event").alias("outcome"), (F.unix_micros("e.ts") - F.unix_micros("a.ts")).cast("double").alias("took_us"))


_SAFE_END = re.compile(r".*[^\W\d_]\s", re.S)


def safe_prefix(text: str) -> int:
    """Characters that can be masked and sent on: up to the last white space after a letter. An identifier
    holds no white space except among digits and their separators, so none reaches across."""
    found = _SAFE_END.match(text)
    return found.end() if found else 0


def mask_text(text: str, names: tuple[str, ...]) -> str:
    for name, pattern in IDENTIFIERS.items():
        if name in names and re.search(HINTS[name], text):
            text = re.sub(pattern, lambda m: "*" * (len(m[0]) - VISIBLE) + m[0][-VISIBLE:] if len(m[0]) > VISIBLE else "*" * len(m[0]), text)
    return text


#: Buckets of responses that share a state, and types of ids that strings stand for exactly.
RESPONSE_BUCKETS = 4096
_SHARING = ("string", "bigint", "int", "smallint", "tinyint")
TERMINAL = ("response.completed", "response.failed", "response.incomplete")


def redact_stream(deltas: DataFrame, names: tuple[str, ...], done_type: str = "output_text.done", timeout_s: int | None = None) -> DataFrame:
    """(response_id, part, text): masked pieces of each response as its deltas arrive; joined by part they
    are the masked whole text, whatever the size of the deltas. A response that ends without text has one empty part.

    deltas: (response_id, sequence_number, type, delta), rows of a response in order over the batches. What may
    still belong to an identifier is held back until an event ``done_type`` or one of TERMINAL flushes it and drops
    the state. ``timeout_s`` seconds without any row do so, too, if given; a stream with timeouts runs on until it is
    stopped, so leave them out where all that is available is to be processed once."""

    kind = dict(deltas.dtypes)["response_id"]
    if timeout_s is None and kind in _SHARING:
        return _redacted_by_bucket(deltas, names, done_type, kind)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        frames = list(parts)
        rows = pd.concat(frames).sort_values("sequence_number", kind="stable") if frames else None
        found = ([], set()) if rows is None else (rows["delta"].tolist(), set(rows["type"]))
        left, piece = _advanced(state.get if state.exists else ("", 0), *found, names, done_type, state.hasTimedOut)
        if left:
            state.update(left)
            if timeout_s is not None:
                state.setTimeoutDuration(timeout_s * 1000)
        elif state.exists:
            state.remove()
        if piece:
            yield pd.DataFrame({"response_id": [key[0]], "part": [piece[0]], "text": [piece[1]]})

    return deltas.groupBy("response_id").applyInPandasWithState(run, f"response_id {kind}, part int, text string", "held string, part int", "append", GroupStateTimeout.NoTimeout if timeout_s is None else GroupStateTimeout.ProcessingTimeTimeout)


def _advanced(before: tuple[str, int], found: list, kinds: set, names: tuple[str, ...], done_type: str, timed_out: bool = False) -> tuple[tuple[str, int] | None, tuple[int, str] | None]:
    """What is held of a response after these deltas, and the part that they complete; None for nothing."""
    held, number = before
    text = held + "".join(d for d in found if isinstance(d, str))
    done = timed_out or done_type in kinds or not kinds.isdisjoint(TERMINAL)
    cut = len(text) if done else safe_prefix(text)
    # a completion that follows the done event finds no state and adds nothing
    told = cut > 0 or (not number and bool(kinds & {done_type, *TERMINAL[1:]}))
    return None if done else (text[cut:], number + told), (number, mask_text(text[:cut], names)) if told else None


def _redacted_by_bucket(deltas: DataFrame, names: tuple[str, ...], done_type: str, kind: str) -> DataFrame:
    """redact_stream without timeouts: the responses of a bucket share a call and a state, which holds those open."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {r: (text, number) for r, text, number in json.loads(state.get[0])} if state.exists else {}
        rows = pd.concat(list(parts)).sort_values("sequence_number", kind="stable")
        found: dict[str | None, tuple[list, set]] = {}
        for r, delta, event in zip(rows["response_id"].tolist(), rows["delta"].tolist(), rows["type"].tolist(), strict=True):
            some, kinds = found.setdefault(r, ([], set()))
            some.append(delta)
            kinds.add(event)
        out = []
        for r, (some, kinds) in found.items():
            left, piece = _advanced(held.pop(r, ("", 0)), some, kinds, names, done_type)
            if left:
                held[r] = left
            if piece:
                out.append((r, *piece))
        if held:
            state.update((json.dumps([(r, *x) for r, x in held.items()]),))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["response_id", "part", "text"])

    # ids go through pandas as strings, for null would turn whole numbers into floats
    rows = deltas.select(F.pmod(F.xxhash64("response_id"), F.lit(RESPONSE_BUCKETS)).alias("bucket"), F.col("response_id").cast("string").alias("response_id"), "sequence_number", "type", "delta")
    parts = rows.groupBy("bucket").applyInPandasWithState(run, "response_id string, part int, text string", "open string", "append", GroupStateTimeout.NoTimeout)
    return parts.select(F.col("response_id").cast(kind).alias("response_id"), "part", "text")


def spend(tokens: float, last: float | None, times: list[float], limit: float = BUCKET, refill_s: float = REFILL_S) -> tuple[list[bool], float, float | None]:
    """Token bucket over ascending times: whether each request passes, and the state after them."""
    passed = []
    for now in times:
        tokens = min(limit, tokens + (now - (now if last is None else last)) * limit / refill_s)
        passed.append(tokens >= 1.0)
        tokens -= passed[-1]
        last = now
    return passed, tokens, last


_NO_CLIENT = object()


def rate_limit_audit(requests: DataFrame, limit: float = BUCKET, refill_s: float = REFILL_S) -> DataFrame:
    """(client_key, ts, allowed) of requests (client_key, ts), by a token bucket for each client.

    A stream keeps a client's tokens and last time as state. A batch streams each client's rows in order
    through its task, batch by batch, and never holds a client whole. Requests without a key share one bucket,
    as one anonymous client."""
    kind = dict(requests.dtypes)["client_key"]
    schema = f"client_key {kind}, ts timestamp, allowed boolean"
    seconds = lambda t: (t.astype("int64") / 1e9 if t.dtype == "datetime64[ns]" else t.astype("datetime64[ns]").astype("int64") / 1e9).tolist()
    if requests.isStreaming:

        def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            tokens, last = state.get if state.exists else (limit, None)
            rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
            allowed, tokens, last = spend(tokens, last, seconds(rows["ts"]), limit, refill_s)
            state.update((tokens, last))
            yield pd.DataFrame({"client_key": key[0], "ts": rows["ts"], "allowed": allowed})

        return requests.groupBy("client_key").applyInPandasWithState(run, schema, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, tokens, last = _NO_CLIENT, limit, None
        for part in batches:
            allowed: list[bool] = []
            for key, rows in part.groupby("client_key", sort=False, dropna=False):
                key = None if pd.isna(key) else key
                if key != current:
                    current, tokens, last = key, limit, None
                got, tokens, last = spend(tokens, last, seconds(rows["ts"]), limit, refill_s)
                allowed += got
            yield part.assign(allowed=allowed)[["client_key", "ts", "allowed"]]

    # keys go through pandas as strings, for null would turn whole numbers into floats
    rows = requests.select(F.col("client_key").cast("string").alias("client_key"), "ts")
    judged = rows.repartition("client_key").sortWithinPartitions("client_key", "ts").mapInPandas(ordered, "client_key string, ts timestamp, allowed boolean")
    return judged.select(F.col("client_key").cast(kind).alias("client_key"), "ts", "allowed")
