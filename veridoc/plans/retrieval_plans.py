"""Queries that retrieve evidence for questions and judge answers by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.functions import text as t
from veridoc.operators import evaluation, index, retrieval, tables
from veridoc.operators.kept_index import TokenIndex
from veridoc.plans import prompts
from veridoc.plans.corpus_plans import CHUNKS, PAGES
from veridoc.plans.inputs import chunk_table, documents, pages, questions, table
from veridoc.plans.policies import PUBLIC
from veridoc.plans.text_plans import DECLINE, PLANNED, sql_denial, sql_tokens
from veridoc.sources import corpus
from veridoc.sources.shared import shared_dir, written

SUBJECT = "documentos técnicos"
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


SCORES = f"""(with q as (select question_id, query_idx, {sql_tokens('query')} as tokens from {PLANNED}), qt as (select question_id, query_idx, len(tokens) as n, unnest(tokens) as token from q),
 d as (select 'doc-' || doc_id || '.md' as document_id, list_distinct({sql_tokens('text')} || {sql_tokens("'doc ' || doc_id || '.md'")}) as tokens from documents), dt as (select document_id, unnest(tokens) as token from d)
 select question_id, query_idx, document_id, count(*) / n as score from qt join dt on qt.token = dt.token group by question_id, query_idx, document_id, n having count(*) / n >= 0.12)"""
MERGED = f"(select question_id, document_id, max(score) as score, min(query_idx) as query_idx from {SCORES} group by all)"
TOP = f"(select * from (select *, row_number() over (partition by question_id order by score desc, query_idx, document_id) as rank from {MERGED}) where rank <= 6)"


def _scores(spark, sf):
    docs = documents(spark, sf).select(F.concat("stem", F.lit(".md")).alias("document_id"), "text")
    queries = retrieval.planned(questions(spark, sf))
    return retrieval.lexical_score(queries, retrieval.indexed(docs)), queries


def _top(spark, sf, k: int = 6):
    scores, queries = _scores(spark, sf)
    return retrieval.topk_hits(retrieval.merge_hits(scores), k), queries


@query("lexical_score", f"select question_id, query_idx, document_id, score from {SCORES}")
def lexical_score(spark, sf):
    return _scores(spark, sf)[0]


def _kept(spark, sf):
    """An index that an older state of the documents made and today's brought up to date: (index, counts of both)."""
    docs = documents(spark, sf).select(F.concat("stem", F.lit(".md")).alias("document_id"), "text", "doc_id")
    k = F.col("doc_id")
    old = docs.filter(k % 10 != 3).withColumn("text", F.when(k % 50 == 7, F.concat(F.lit("antigua "), "text")).otherwise(F.col("text")))
    gone = docs.filter(k % 25 == 1).withColumn("document_id", F.concat(F.lit("retired-"), "document_id"))
    index = TokenIndex(spark, shared_dir(spark, "kept-index"))
    return index, [index.update(old.unionByName(gone)), index.update(docs)]


@query("lexical_score_kept", f"select question_id, query_idx, document_id, score from {SCORES}")
def lexical_score_kept(spark, sf):
    """lexical_score from a kept index that was brought up to date, not rebuilt."""
    return _kept(spark, sf)[0].search(retrieval.planned(questions(spark, sf)))


@query(
    "index_update",
    """select * from (values (1, 'new', (select count(*) from documents where doc_id % 10 <> 3) + (select count(*) from documents where doc_id % 25 = 1)), (1, 'changed', 0), (1, 'deleted', 0),
    (2, 'new', (select count(*) from documents where doc_id % 10 = 3)), (2, 'changed', (select count(*) from documents where doc_id % 50 = 7 and doc_id % 10 <> 3)), (2, 'deleted', (select count(*) from documents where doc_id % 25 = 1)),
    (2, 'live', (select count(*) from documents))) t(step, action, n)""",
)
def index_update(spark, sf):
    """How many documents each update of a kept index found new, changed and deleted, and how many it then holds."""
    index, counts = _kept(spark, sf)
    rows = [(i, a, n) for i, c in enumerate(counts, 1) for a, n in c.items()]
    held = index.documents().agg(F.lit(2).alias("step"), F.lit("live").alias("action"), F.count("*").alias("n"))
    return spark.createDataFrame(rows, "step int, action string, n long").unionByName(held)


@query("query_union", f"select question_id, count(*) as n_variants, string_agg(query, chr(10) order by query_idx) as variants from {PLANNED} group by all")
def query_union(spark, sf):
    rows = retrieval.planned(questions(spark, sf)).groupBy("question_id").agg(F.count("*").alias("n_variants"), F.sort_array(F.collect_list(F.struct("query_idx", "query"))).alias("x"))
    return rows.select("question_id", "n_variants", F.array_join(F.transform("x", lambda v: v["query"]), "\n").alias("variants"))


@query("merge_hits", f"select question_id, document_id, score, query_idx from {MERGED}")
def merge_hits(spark, sf):
    return retrieval.merge_hits(_scores(spark, sf)[0])


@query("topk_hits", f"select question_id, document_id, score, query_idx, rank from {TOP}")
def topk_hits(spark, sf):
    return _top(spark, sf)[0]


@query(
    "retrieval_receipts",
    f"""select v.q as question_id, coalesce(string_agg(document_id, ',' order by rank), '') as documents, coalesce(string_agg(printf('%.4f', round_even(score, 4)), ',' order by rank), '') as scores, count(rank) as n_results, any_value(v.n) as n_queries
    from (select question_id as q, count(*) as n from {PLANNED} group by 1) v left join {TOP} on v.q = question_id group by v.q""",
)
def retrieval_receipts(spark, sf):
    """Flagship: what each question of the benchmark retrieves from all documents, as auditable receipts; a question
    without evidence has one, too."""
    top, queries = _top(spark, sf)
    r = retrieval.receipts(top, queries)
    scores = F.array_join(F.transform("results", lambda x: F.format_string("%.4f", x["score"])), ",")
    return r.select("question_id", F.array_join("documents", ",").alias("documents"), scores.alias("scores"), F.size("results").cast("long").alias("n_results"), F.size("queries").cast("long").alias("n_queries"))


@query("topic_isolation", f"select question_id, document_id, score from (select s.*, d.lang as topic from {MERGED} s join documents d on document_id = 'doc-' || d.doc_id || '.md') where topic = case question_id % 4 when 0 then 'en' when 1 then 'fr' when 2 then 'de' else 'es' end")
def topic_isolation(spark, sf):
    merged = merge_hits(spark, sf)
    topics = documents(spark, sf).select(F.concat("stem", F.lit(".md")).alias("document_id"), F.col("lang").alias("profile"))
    k = F.col("question_id") % 4
    asked = questions(spark, sf).select("question_id", F.when(k == 0, "en").when(k == 1, "fr").when(k == 2, "de").otherwise("es").alias("profile"))
    return merged.join(topics, "document_id").join(asked, ["question_id", "profile"]).select("question_id", "document_id", "score")


COSINE = "list_cosine_similarity(q.embedding::double[], v.embedding::double[])"


@query("vector_score", f"select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, v.vec_id, {COSINE} as score from embeddings q, embeddings v where q.vec_id % 50 = 0)) where rank <= 10")
def vector_score(spark, sf):
    v = table(spark, sf, "embeddings")
    asked = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_score(v, asked, 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query("vector_topics", f"select query_id, vec_id, round(score, 6) as score, rank from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from (select q.vec_id as query_id, v.vec_id, {COSINE} as score from embeddings q join embeddings v on q.label = v.label where q.vec_id % 50 = 0)) where rank <= 10")
def vector_topics(spark, sf):
    v = table(spark, sf, "embeddings")
    asked = v.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id")
    return retrieval.vector_score(v, asked, 10, topic="label").select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


NORMAL = "trim(regexp_replace(strip_accents(lower({0})), '\\s+', ' ', 'g'))"
C_LINES = f"(select *, list_distinct([y for y in [{NORMAL.format('x')} for x in string_split(text, chr(10))] if length(y) >= 14 and regexp_matches(y, '[a-z]{{4}}')])[1:60] as lines from {CHUNKS})"


@query("citation_lines", f"select document_id, len(lines) as n_lines, md5(array_to_string(list_sort(lines), chr(10))) as lines_md5 from {C_LINES}")
def citation_lines(spark, sf):
    rows = chunk_table(spark, sf).withColumn("lines", retrieval.citation_lines(F.col("text")))
    return rows.select("document_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join(F.array_sort("lines"), "\n")).alias("lines_md5"))


@query(
    "citation_locator",
    f"""with c as (select * from {C_LINES} where len(lines) > 0), p as (select doc_id, page_no, regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g') as plain from {PAGES}),
    h as (select c.document_id, c.doc_id, page_no, len([x for x in lines if contains(plain, x)]) as hits, len(lines) as n from c join p on p.doc_id = c.doc_id),
    w as (select *, min(case when hits = n then page_no end) over (partition by document_id) as whole from h where hits > 0)
    select document_id, doc_id, page_no, hits from (select *, row_number() over (partition by document_id order by hits desc, page_no) as r from w where whole is null or page_no <= whole) where r = 1""",
)
def citation_locator(spark, sf):
    rows = chunk_table(spark, sf).withColumn("doc_id", F.split_part("stem", F.lit("-"), F.lit(2)).cast("long"))
    found = retrieval.citation_locator(rows.select("document_id", "doc_id", "text"), pages(spark, sf))
    return found.select("document_id", "doc_id", F.col("page_no").cast("long").alias("page_no"), F.col("hits").cast("long").alias("hits"))


CONTEXT = "string_agg('[' || document_id || '] (lang=' || lang || ', n=' || n_chars || ')' || chr(10) || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rank)"


@query("render_context", f"select question_id, md5({CONTEXT}) as context_md5 from {TOP} join documents d on document_id = 'doc-' || d.doc_id || '.md' group by question_id")
def render_context(spark, sf):
    return _contexts(spark, sf).select("question_id", F.md5("context").alias("context_md5"))


def _contexts(spark, sf):
    docs = documents(spark, sf).select(F.concat("stem", F.lit(".md")).alias("document_id"), "text", F.create_map(F.lit("n"), F.col("n_chars").cast("string"), F.lit("lang"), F.col("lang")).alias("metadata"))
    return prompts.render_context(_top(spark, sf)[0].join(docs, "document_id").withColumn("citation", F.col("document_id")))


@query(
    "build_prompt",
    f"""select b.item_id as question_id, case when b.item_id % 3 = 0 then '{prompts.PREFERENCES}' || chr(10) || b.text || chr(10) || chr(10) else '' end || '{prompts.rules_text(PUBLIC, SUBJECT)}' || chr(10) || chr(10)
    || case when c.context is null then 'FRAGMENTOS: (ninguno)' else 'FRAGMENTOS:' || chr(10) || chr(10) || c.context end || chr(10) as prompt
    from benchmark b left join (select question_id, {CONTEXT} as context from {TOP} join documents d on document_id = 'doc-' || d.doc_id || '.md' group by question_id) c on c.question_id = b.item_id""",
)
def build_prompt(spark, sf):
    """Every question's prompt; every third has its own text as a system turn, too."""
    wishes = table(spark, sf, "benchmark").select(F.col("item_id").alias("question_id"), F.when(F.col("item_id") % 3 == 0, F.array("text")).alias("turns"))
    return prompts.build_prompt(wishes.join(_contexts(spark, sf), "question_id", "left"), PUBLIC, SUBJECT, system_col="turns")


@query(
    "index_reached",
    f"""select item_id as question_id, count(t.document_id) as n_cards, count(t.document_id) > 0 as ok from benchmark left join
    (select question_id, document_id from {TOP} join documents d on document_id = 'doc-' || d.doc_id || '.md' where rank <= 5 and d.doc_id % 3 = 0) t on t.question_id = item_id group by item_id""",
)
def index_reached(spark, sf):
    """Every third document stands for an index card."""
    cards = documents(spark, sf).filter("doc_id % 3 = 0").select(F.concat("stem", F.lit(".md")).alias("name"))
    return index.index_reached(questions(spark, sf), _top(spark, sf)[0], cards)


@query("extractive_answer")
def extractive_answer(spark, sf):
    docs = documents(spark, sf).select(F.concat("stem", F.lit(".md")).alias("document_id"), "text")
    top = _top(spark, sf)[0].join(docs, "document_id")
    hits = top.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "document_id", "text"))), lambda x: F.struct(x["document_id"].alias("document_id"), x["text"].alias("text"))).alias("hits"))
    asked = questions(spark, sf).withColumn("query_tokens", t.token_set(F.col("question")))
    return evaluation.extractive_answer(asked.join(hits, "question_id", "left"), DECLINE).select("question_id", "answer")


#: Two corpora of all documents: in "a" documents of odd ids say their lines as rows of a table under a version, in "b"
#: those whose id is divisible by three do, and documents divisible by seven are missing.
def _table_sql(tabled: str, where: str) -> str:
    return f"""(select doc_id, case when {tabled} then '| Equipo | BASE |' || chr(10) || '|---|---|' || chr(10) || '| ' || replace(replace(text, '|', '/'), chr(10), ' | • |' || chr(10) || '| ') || ' | • |' else text end as text from documents where {where})"""


CORPORA = {"a": ("doc_id % 2 = 1", "true"), "b": ("doc_id % 3 = 0", "doc_id % 7 <> 0")}
BENCH_HITS = " union all ".join(
    f"select '{name}' as corpus, t.question_id, t.rank, d.text, cast({tabled} as boolean) as tabled, string_split(d.text, chr(10)) as ls from {TOP.replace('from documents)', 'from ' + _table_sql(tabled, where) + ')')} t join {_table_sql(tabled, where)} d on t.document_id = 'doc-' || d.doc_id || '.md'"
    for name, (tabled, where) in CORPORA.items()
)


@query(
    "retrieval_bench",
    f"""with h as ({BENCH_HITS}), q as (select item_id, strip_accents(lower(text)) as f from benchmark),
    x as (select corpus, question_id, rank, tabled and len(list_filter(ls, lambda l: contains(strip_accents(lower(l)), f))) > 0 as ok from h join q on q.item_id = h.question_id where contains(strip_accents(lower(text)), f)),
    y as (select corpus, question_id, arg_min(ok, rank) as ok from x group by all), c as (select question_id from y group by 1 having count(*) = 2), n as (select count(*) as total from benchmark),
    z as (select corpus, count(*) as found, count(*) filter (ok) as attributable, count(*) filter (question_id in (select * from c)) as n_common, count(*) filter (ok and question_id in (select * from c)) as attributable_common from y group by corpus)
    select corpus, total, coalesce(found, 0) as found, coalesce(attributable, 0) as attributable, round_even(100.0 * coalesce(found, 0) / total, 1)::double as pct_found, round_even(100.0 * coalesce(attributable, 0) / total, 1)::double as pct_attributable,
    coalesce(n_common, 0) as n_common, coalesce(attributable_common, 0) as attributable_common, case when n_common > 0 then round_even(100.0 * attributable_common / n_common, 1) else 0 end::double as pct_common from (select distinct corpus from h) left join z using (corpus), n""",
)
def retrieval_bench(spark, sf):
    """Benchmark questions over two corpora that keep different documents and say different ones as tables."""
    docs = documents(spark, sf).select("doc_id", F.concat("stem", F.lit(".md")).alias("document_id"), "text")
    body = F.replace(F.replace("text", F.lit("|"), F.lit("/")), F.lit("\n"), F.lit(" | • |\n| "))
    rows = F.concat(F.lit("| Equipo | BASE |\n|---|---|\n| "), body, F.lit(" | • |"))
    asked = questions(spark, sf)
    queries = retrieval.planned(asked)
    hits = None
    for name, (tabled, where) in CORPORA.items():
        side = docs.filter(where).select("document_id", F.when(F.expr(tabled), rows).otherwise(F.col("text")).alias("text"))
        scores = retrieval.lexical_score(queries, retrieval.indexed(side))
        top = retrieval.topk_hits(retrieval.merge_hits(scores), 6).join(side, "document_id").select(F.lit(name).alias("corpus"), "question_id", "document_id", "rank", "text")
        hits = top if hits is None else hits.unionByName(top)
    return evaluation.retrieval_bench(written(hits, "bench-hits"), asked.select("question_id", F.col("question").alias("feature"), F.lit("base").alias("version")))


JUDGED = f"""(select *, reason in ('denied', 'masked', 'grounded') as correct from (select id, model, kind, ttft_s, case when contains(lower(answer), lower(forbidden)) then 'leaked' when kind = 'negativa' then case when denied then 'denied' else 'not_denied' end
 when not retrieved then 'not_retrieved' when kind = 'enmascarada' then case when uncited then 'masked_uncited' else 'masked' end when denied and uncited then 'denied_with_evidence' when uncited then 'uncited' else 'grounded' end as reason
 from (select *, {sql_denial('answer').replace("contains(lower(answer), '" + DECLINE.lower().rstrip('.') + "') or ", '')} as denied, conv_id % 7 <> 0 as retrieved, not contains(answer, '[' || chunk || ']') as uncited from
 (select conv_id, conv_id || '-' || turn as id, 'm' || (turn % 3) as model, case conv_id % 3 when 0 then 'positiva' when 1 then 'negativa' else 'enmascarada' end as kind, 'zz' || (conv_id % 5) as forbidden, 'doc-' || (conv_id % 10) || '--001.md' as chunk,
  text || case when turn % 3 = 1 then ' No consta' else '' end || case when (conv_id + turn) % 4 <> 0 then ' [doc-' || (conv_id % 10) || '--001.md]' else '' end || case when conv_id % 11 = 0 then ' ZZ0' else '' end as answer, length(text) / 100.0 as ttft_s from conversations where role = 'assistant'))))"""


def _judged(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    c, n = F.col("conv_id"), F.col("turn")
    doc = F.concat(F.lit("doc-"), (c % 10).cast("string"))
    chunk = F.concat(doc, F.lit("--001.md"))
    said = F.concat("text", F.when(n % 3 == 1, " No consta").otherwise(""), F.when((c + n) % 4 != 0, F.concat(F.lit(" ["), chunk, F.lit("]"))).otherwise(""), F.when(c % 11 == 0, " ZZ0").otherwise(""))
    answers = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.concat(F.lit("m"), (n % 3).cast("string")).alias("model"), said.alias("answer"), F.when(c % 7 != 0, F.array(chunk)).otherwise(F.array(F.lit("doc-x.md"))).alias("documents"), (F.length("text") / 100.0).alias("ttft_s"))
    golden = rows.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(c % 3 == 0, "positiva").when(c % 3 == 1, "negativa").otherwise("enmascarada").alias("kind"), F.concat(doc, F.lit(".md")).alias("expected_doc"), F.array(F.concat(F.lit("zz"), (c % 5).cast("string"))).alias("forbidden"))
    # the retrieved chunk of a question that found nothing is another document's
    joined = golden.join(answers, "id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    return evaluation.verdicts(joined)


@query("verdict", f"select id, model, kind, reason, correct from {JUDGED}")
def verdict(spark, sf):
    return _judged(spark, sf).select("id", "model", "kind", "reason", "correct")


@query(
    "golden_join",
    f"""select b.item_id as id, case b.item_id % 3 when 0 then 'positiva' when 1 then 'negativa' else 'enmascarada' end as kind, count(t.document_id) as n_documents, coalesce(bool_or(t.document_id = 'doc-' || b.item_id || '.md'), false) as expected_found
    from benchmark b left join {TOP} t on t.question_id = b.item_id group by 1, 2""",
)
def golden_join(spark, sf):
    """Golden questions with what was retrieved for each, questions without evidence included."""
    k = F.col("question_id") % 3
    golden = questions(spark, sf).select(F.col("question_id").alias("id"), F.when(k == 0, "positiva").when(k == 1, "negativa").otherwise("enmascarada").alias("kind"), F.concat(F.lit("doc-"), F.col("question_id").cast("string"), F.lit(".md")).alias("expected_doc"))
    top, queries = _top(spark, sf)
    answers = retrieval.receipts(top, queries).select(F.col("question_id").alias("id"), "documents")
    return evaluation.golden_join(golden, answers)


@query(
    "golden_check",
    """with g as (select case when item_id % 10 = 9 then item_id - 1 else item_id end as n, item_id, case when item_id % 7 = 6 then 'otra' when item_id % 3 = 0 then 'positiva' when item_id % 3 = 1 then 'negativa' else 'enmascarada' end as kind,
    case when item_id % 4 = 3 then null when item_id % 5 = 4 then 'doc-x' || item_id || '.md' else 'doc-' || item_id || '.md' end as doc, item_id % 8 <> 1 as declines from benchmark)
    select 'q' || n as id, problem from (select n, 'unknown_kind' as problem from g where kind = 'otra' union all select n, 'expects_no_document' from g where kind = 'positiva' and doc is null union all select n, 'must_decline' from g where kind = 'negativa' and not declines
    union all select n, 'not_in_corpus' from g where doc is not null and doc not in (select 'doc-' || doc_id || '.md' from documents) union all select n, 'repeated_id' from g group by n having count(*) > 1)""",
)
def golden_check(spark, sf):
    """Golden questions from JSON lines, some of them wrong, held against the chunks of all documents."""
    k = F.col("item_id")
    rows = table(spark, sf, "benchmark").select(
        F.concat(F.lit("q"), F.when(k % 10 == 9, k - 1).otherwise(k).cast("string")).alias("id"),
        F.col("text").alias("pregunta"),
        F.when(k % 7 == 6, "otra").when(k % 3 == 0, "positiva").when(k % 3 == 1, "negativa").otherwise("enmascarada").alias("tipo"),
        F.when(k % 4 == 3, None).when(k % 5 == 4, F.concat(F.lit("doc-x"), k.cast("string"), F.lit(".md"))).otherwise(F.concat(F.lit("doc-"), k.cast("string"), F.lit(".md"))).alias("documento_esperado"),
        (k % 8 != 1).alias("debe_declinar"),
    )
    path = shared_dir(spark, "golden")
    rows.write.json(path)
    return corpus.golden_problems(corpus.read_golden_files(spark, path), chunk_table(spark, sf).select("document_id"))


@query("eval_summary", f"select model, count(*) filter (correct) as n_correct, count(*) as n, count(*) filter (kind = 'negativa' and correct) as n_negative_correct, count(*) filter (kind = 'negativa') as n_negative, list_sort(list(ttft_s))[len(list(ttft_s)) // 2 + 1] as ttft_p50 from {JUDGED} group by model")
def eval_summary(spark, sf):
    return evaluation.eval_summary(_judged(spark, sf))


@query("eval_gate", f"select case when count(*) filter (not correct and kind = 'negativa') > 0 then 1 when count(*) filter (not correct) > 0 then 2 else 0 end as gate from {JUDGED}")
def eval_gate(spark, sf):
    return evaluation.eval_gate(_judged(spark, sf))
