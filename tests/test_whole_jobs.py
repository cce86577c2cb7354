"""Queries that do the whole job, against brute force over all rows of the given tables or inline ones."""

import re
import unicodedata
from collections import Counter
from hashlib import md5, sha256
from math import ceil

import duckdb
import pytest
from pyspark.sql import functions as F

from veridoc.operators import chunking, evaluation
from veridoc.plans import corpus_plans, derived_plans, stream_plans, text_plans
from veridoc.plans.policies import PUBLIC, Chunking
from veridoc.streaming import events

SF = "/root/testdata/sf0.001"


def hashed(text):
    return md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").collect()


def test_chunk_rows_of_split_documents(spark, docs):
    rows = corpus_plans.QUERIES["chunk_rows_all"](spark, SF).collect()
    got = Counter((r.doc_id, r.text_md5, r.fragmento, r.fragmentos_totales) for r in rows)
    wanted = Counter()
    for d in docs:
        parts = chunking.chunk_text(d.text, PUBLIC.chunking)
        wanted.update((d.doc_id, hashed(p), *((i, len(parts)) if len(parts) > 1 else (None, None))) for i, p in enumerate(parts, 1))
    assert got == wanted and any(r.fragmento for r in rows)
    assert all(r.document_id == f"doc-{r.doc_id}" + (f"--{r.fragmento:03d}" if r.fragmento else "") for r in rows)


def test_manifest_has_every_chunk(spark, docs):
    rows = corpus_plans.QUERIES["manifest_chunks"](spark, SF)
    assert "fragmento" in rows.columns and "fragmentos_totales" not in rows.columns
    got = Counter((r.document_id, r.caracteres, r.fragmento, r.idioma) for r in rows.collect())
    wanted = Counter()
    for d in docs:
        parts = chunking.chunk_text(d.text, PUBLIC.chunking)
        split = len(parts) > 1
        wanted.update((f"doc-{d.doc_id}" + (f"--{i:03d}" if split else ""), len(p), str(i) if split else "", d.lang) for i, p in enumerate(parts, 1))
    assert got == wanted


def test_density_gate_counts_every_page(spark, docs):
    wanted = {}
    for d in docs:
        lines = d.text.split("\n")
        pages = ["\n".join(lines[i : i + 4]) for i in range(0, len(lines), 4)]
        texts = [p.strip(" ") for i, p in enumerate(pages) if (d.doc_id + i) % 3]
        n_chars = sum(map(len, texts)) + max(2 * (sum(map(bool, texts)) - 1), 0)
        wanted[d.doc_id] = (len(pages), n_chars, n_chars / len(pages) >= 200)
    got = {r.doc_id: (r.n_pages, r.n_chars, r.dense) for r in corpus_plans.QUERIES["density_gate_all"](spark, SF).collect()}
    assert got == wanted and len(got) == len(docs)


def test_pending_work_of_every_length(spark, docs):
    key = lambda d: sha256(f"v3|motor|200|{ceil(d.n_chars / 2000)}|{d.text}".encode()).hexdigest()
    cached = {key(d) for d in docs if d.doc_id % 3 == 0}
    n_pages = [ceil(d.n_chars / 2000) for d in docs if key(d) not in cached]
    assert max(n_pages) > 2
    got = corpus_plans.QUERIES["pending_work_all"](spark, SF).first()
    assert (got.n_pending, got.n_pages) == (len(n_pages), sum(n_pages)) and got.usd == pytest.approx(sum(n_pages) * 0.015)


def test_slug_of_whole_texts(spark, docs):
    fold = lambda x: "".join(c for c in unicodedata.normalize("NFD", x.lower()) if not unicodedata.combining(c))
    wanted = {d.doc_id: "-".join(re.findall("[a-z0-9]+", fold(d.text))) for d in docs}
    got = {r.doc_id: r.slug_md5 for r in text_plans.QUERIES["slug_all"](spark, SF).collect()}
    assert got == {k: hashed(v) for k, v in wanted.items()} and any(len(v) > 80 for v in wanted.values())


def tabled(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")


def test_streams_keep_empty_and_null_texts(spark, tmp_path):
    tabled(spark, tmp_path, "documents", [(1, ""), (2, None), (3, "tel 55 1234 5678 " * 9), (4, "x" * 64)], "doc_id long, text string")
    rows = {r.response_id: r for r in stream_plans.QUERIES["redact_stream"](spark, str(tmp_path)).collect()}
    assert sorted(rows) == [1, 2, 3, 4] and all(r.same for r in rows.values())
    assert rows[1].text_md5 == rows[2].text_md5 == hashed("")
    tabled(spark, tmp_path, "conversations", [(4, 0, "user", ""), (4, 1, "assistant", ""), (8, 0, "user", None), (9, 0, "user", "No "), (9, 1, "assistant", "consta")], "conv_id long, turn int, role string, text string")
    got = {r.response_id: r.text_md5 for r in stream_plans.QUERIES["stream_answers"](spark, str(tmp_path)).collect()}
    assert got == {4: hashed(""), 8: hashed(""), 9: hashed("No consta")}
    judged = {r.response_id: (r.is_denial, r.is_grounded) for r in stream_plans.QUERIES["finished_answers"](spark, str(tmp_path)).collect()}
    assert judged == {4: (False, False), 8: (False, False), 9: (True, True)}


def test_stream_answers_equals_its_twin(spark):
    duck = duckdb.connect()
    duck.sql(f"create view conversations as select * from '{SF}/conversations.parquet'")
    wanted = sorted(duck.sql(stream_plans.SQL["stream_answers"]).fetchall())
    assert sorted(map(tuple, stream_plans.QUERIES["stream_answers"](spark, SF).collect())) == wanted
    judged = stream_plans.QUERIES["finished_answers"](spark, SF).collect()
    assert len(judged) == len(wanted) and {r.is_grounded for r in judged} == {True, False} == {r.is_denial for r in judged}


def test_deltas_are_written_by_many_tasks(spark, monkeypatch):
    seen = []
    kept = stream_plans._as_stream
    monkeypatch.setattr(stream_plans, "_as_stream", lambda s, rows, name: seen.append(rows.rdd.getNumPartitions()) or kept(s, rows, name))
    stream_plans.QUERIES["stream_answers"](spark, SF).collect()
    assert seen[0] > 1


def test_upper_median_is_counted_before_the_shuffle(spark):
    rows = [("a", x) for x in (3.0, 1.0, 1.0, float("nan"), None, 2.0)] + [("b", None), ("c", 5.0), (None, 7.0), (None, 8.0), ("d", 4.0), ("d", 4.0), ("d", 9.0)]
    judged = spark.createDataFrame(rows, "model string, ttft_s double").withColumns({"kind": F.lit("positiva"), "correct": F.lit(True)})
    out = evaluation.eval_summary(judged)
    got = {r.model: (r.n, r.ttft_p50) for r in out.collect()}
    assert got == {"a": (6, 2.0), "b": (1, None), "c": (1, 5.0), None: (2, 8.0), "d": (3, 4.0)}
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def bucket(times, limit, refill_s):
    tokens, last, passed = limit, times[0], []
    for now in times:
        tokens, last = min(limit, tokens + (now - last).total_seconds() * limit / refill_s), now
        passed.append(tokens >= 1)
        tokens -= passed[-1]
    return passed


def test_rate_limit_audit_of_every_user(spark):
    by_user = {}
    for r in spark.read.parquet(f"{SF}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").collect():
        by_user.setdefault(r.user_id, []).append(r.ts)
    got = Counter((r.client_key, r.ts, r.allowed) for r in stream_plans.QUERIES["rate_limit_audit"](spark, SF).collect())
    assert got == Counter((u, x, p) for u, times in by_user.items() for x, p in zip(times, bucket(times, 2.0, 86_400.0)))
    assert {a for _, _, a in got} == {True, False}


def test_rate_limit_audit_keeps_requests_without_a_key(spark):
    big = 2**53 + 1
    rows = spark.createDataFrame([(None, i) for i in range(25)] + [(big, i) for i in range(3)], "client_key long, s long").select("client_key", F.timestamp_millis("s").alias("ts"))
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = events.rate_limit_audit(rows).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert Counter((r.client_key, r.allowed) for r in out) == {(None, True): 20, (None, False): 5, (big, True): 3}


def test_white_space_and_folding(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from veridoc.functions import text as t

    rows = ["Việt ﬁn Άλφα Ａ", "\t Ñandú\r\n", "ĳ ŉ ǆ", "Ёлка й", "plain", ""]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").select("i", t.fold(F.col("s")).alias("f"), t.strip(F.col("s")).alias("s"), t.lines(F.col("s")).alias("l")).orderBy("i").collect()
    for r, s in zip(got, rows, strict=True):
        assert r.f == "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c)) or r.f == t.fold_any.func(__import__("pandas").Series([s]))[0]
        assert r.s == s.strip()
    assert got[1].l == ["\t Ñandú", ""]


def test_stop_word_questions_have_variants_receipts_and_decline(spark):
    from pyspark.sql import functions as F

    from veridoc.operators import evaluation, retrieval

    asked = spark.createDataFrame([(1, " de la que\t"), (2, "torque máximo"), (3, "\n")], "question_id long, question string")
    planned = retrieval.planned(asked)
    assert sorted((r.question_id, r.query, len(r.tokens)) for r in planned.collect())[0] == (1, "de la que", 0)
    index = retrieval.indexed(spark.createDataFrame([("a", "torque de 5")], "document_id string, text string"))
    top = retrieval.topk_hits(retrieval.merge_hits(retrieval.lexical_score(planned, index)), 3)
    got = {r.question_id: r for r in retrieval.receipts(top, planned).collect()}
    assert [r.document_id for r in got[2].results] == ["a"] and got[1].results == [] and 3 not in got
    rows = spark.createDataFrame([(1, ["torque"], None), (2, ["torque"], [("a", "El torque es 5.")]), (3, ["torque", "xenon"], [("a", "El torque es 5.")] * 3)], "i int, query_tokens array<string>, hits array<struct<document_id:string,text:string>>")
    said = {r.i: r.answer for r in evaluation.extractive_answer(rows, "No consta.").select("i", F.col("answer")).collect()}
    assert said[1] == said[3] == "No consta." and "torque es 5 [a]" in said[2]


def test_failed_responses_flush_what_is_held(spark, tmp_path):
    from veridoc.streaming import events as ev
    from veridoc.streaming.runner import run_available

    rows = [(1, 0, "output_text.delta", "uno 5512345678"), (1, 1, "response.failed", None), (2, 0, "output_text.delta", "dos"), (2, 1, "output_text.done", None), (2, 2, "response.completed", None), (3, 0, "response.failed", None)]
    df = spark.createDataFrame(rows, "response_id long, sequence_number long, type string, delta string")
    df.write.parquet(str(tmp_path / "d"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "d"))
    got = sorted((r.response_id, r.part, r.text) for r in run_available(ev.redact_stream(stream, ("telefono",)), "failed").collect())
    assert [g[0] for g in got] == [1, 1, 2, 3] or [g[0] for g in got] == [1, 2, 3]
    whole = "".join(g[2] for g in got if g[0] == 1)
    assert whole.startswith("uno ") and whole.endswith("5678") and "55123" not in whole


def test_streamed_windows_equal_the_batch(spark):
    from veridoc.plans import stream_plans

    exact = ["period", "n", "n_errors", "n_ungrounded"]
    sf = "/root/testdata/sf0.001"
    streamed = stream_plans.QUERIES["metric_windows_stream"](spark, sf).select(exact).collect()
    batch = stream_plans.ev.metric_windows(stream_plans.telemetry(spark, sf)).select(exact).collect()
    assert sorted(map(tuple, streamed)) == sorted(map(tuple, batch))


def test_table_function_cuts_like_chunk_text(spark, docs):
    found = {(r.doc_id, r.chunk_index): (r.chunk_total, r.chunk_md5) for r in derived_plans.chunk_text_udtf(spark, SF).collect()}
    want = {}
    for r in docs:
        parts = chunking.chunk_text(r.text, Chunking(2000, 250, 2600))
        want |= {(r.doc_id, i): (len(parts), hashed(p)) for i, p in enumerate(parts, 1)}
    assert found == want
