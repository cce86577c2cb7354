"""Queries over text scalars and per-document rules, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions import text as t
from veridoc.operators import predicates as p
from veridoc.plans.inputs import documents, questions, table
from veridoc.plans.policies import PUBLIC

QUERIES: dict = {}
SQL: dict[str, str] = {}
DECLINE = PUBLIC.decline


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


STOP = f"[{quoted(t.STOPWORDS)}]"
WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


def sql_words(c: str) -> str:
    return f"[w for w in {WORDS.format(c)} if length(w) > 2 and not list_contains({STOP}, strip_accents(w))]"


def sql_tokens(c: str) -> str:
    return f"list_distinct([strip_accents(w) for w in {sql_words(c)}])"


DOCS = "(select *, 'doc-' || doc_id as stem, source || '/' || lang || '/doc-' || doc_id || '.md' as path from documents)"


def sql_slug(c: str) -> str:
    return f"trim(regexp_replace(strip_accents(lower({c})), '[^a-z0-9]+', '-', 'g'), '-')"


@query("fold", "select doc_id, md5(strip_accents(lower(text))) as folded_md5 from documents")
def fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(t.fold(F.col("text"))).alias("folded_md5"))


@query("slug", f"select doc_id, md5({sql_slug('text')}) as slug_md5 from documents")
@query("slug_all", f"select doc_id, md5({sql_slug('text')}) as slug_md5 from documents")
def slug(spark, sf):
    """Slugs of whole texts (under two names, an older one had short slugs)."""
    return table(spark, sf, "documents").select("doc_id", F.md5(t.slug(F.col("text"))).alias("slug_md5"))


@query(
    "doc_type",
    f"""with s as (select doc_id, {sql_slug("split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) || ' ' || source")} as s from documents)
    select doc_id, case when starts_with(s, 'cv') then 'cv' when contains(s, 'certificado') or contains(s, 'constancia') then 'certificado'
    when contains(s, 'titulo') then 'titulo' when contains(s, 'ficha') or contains(s, 'especificacion') then 'ficha_tecnica'
    when contains(s, 'folleto') or contains(s, 'catalogo') or contains(s, 'brochure') then 'folleto' else 'documento' end as tipo from s""",
)
def doc_type(spark, sf):
    # the first two words, without cutting the whole text
    name = F.concat_ws(" ", F.substring_index("text", " ", 2), "source")
    return table(spark, sf, "documents").select("doc_id", t.doc_type(name).alias("tipo"))


@query("year_in", "select doc_id, cast(nullif(regexp_extract(cast(doc_id * 7 + 1800 as varchar) || ' ' || text, '(19|20)[0-9]{2}'), '') as integer) as anio from documents")
def year_in(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.year_in(F.concat_ws(" ", (F.col("doc_id") * 7 + 1800).cast("string"), "text")).alias("anio"))


@query("path_metadata", f"select doc_id, {sql_slug('source')} as origen, {sql_slug('lang')} as idioma from {DOCS}")
def path_metadata(spark, sf):
    names = list(PUBLIC.path_metadata)
    docs = documents(spark, sf)
    parts = F.transform(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), t.slug)
    kept = F.map_from_arrays(F.slice(F.array(*map(F.lit, names)), 1, F.least(F.lit(len(names)), F.size(parts))), F.slice(parts, 1, len(names)))
    return docs.withColumn("m", kept).select("doc_id", *[F.element_at("m", n).alias(n) for n in names])


CLASS = """case when contains(upper(text), 'MIT LICENSE') or contains(upper(text), 'CC BY') then 'licencia'
 when regexp_full_match(path, '(?s)src1.*/.*') then 'abierta' else 'ficha' end"""


@query("classify", f"select doc_id, {CLASS} as clase from {DOCS}")
def classify(spark, sf):
    return _classified(spark, sf).select("doc_id", "clase")


def _classified(spark, sf):
    return documents(spark, sf).withColumn("clase", p.classify(F.col("path"), t.doc_type(F.col("stem")), F.col("text"), PUBLIC.documents))


@query("exposure", f"select doc_id, clase, clase in ('abierta', 'licencia') as exposed from (select doc_id, {CLASS} as clase from {DOCS})")
def exposure(spark, sf):
    return _classified(spark, sf).select("doc_id", "clase", p.exposed(F.col("clase"), PUBLIC.documents).alias("exposed"))


@query("originals_to_publish", f"select doc_id, path from {DOCS} where regexp_full_match(path, '(?s)src1.*/.*')")
def originals_to_publish(spark, sf):
    docs = documents(spark, sf)
    kind = p.classify(F.col("path"), F.lit(""), F.lit(""), PUBLIC.documents)
    return docs.filter(p.exposed(kind, PUBLIC.documents)).select("doc_id", "path")


@query("condense", f"select doc_id, md5(array_to_string({sql_words('text')}, ' ')) as condensed_md5 from documents")
def condense(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.condense(F.col("text"))).alias("condensed_md5"))


PLANNED = f"""(select item_id as question_id, unnest(case when trim(text) = '' then [] when c = '' or lower(c) = lower(trim(text)) then [trim(text)] else [trim(text), c] end) as query,
 unnest(case when trim(text) = '' then [] when c = '' or lower(c) = lower(trim(text)) then [0] else [0, 1] end) as query_idx
 from (select item_id, text, array_to_string({sql_words('text')}, ' ') as c from benchmark))"""


@query("plan_queries", f"select question_id, query_idx, query from {PLANNED}")
def plan_queries(spark, sf):
    return questions(spark, sf).select("question_id", F.posexplode(t.plan_queries(F.col("question"))).alias("query_idx", "query"))


@query("token_set", f"select doc_id, len(x) as n_tokens, md5(array_to_string(list_sort(x), ' ')) as tokens_md5 from (select doc_id, {sql_tokens('text')} as x from documents)")
def token_set(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", t.token_set(F.col("text")).alias("x"))
    return rows.select("doc_id", F.size("x").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("x"), " ")).alias("tokens_md5"))


@query("mask_identifiers")
def mask_identifiers(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.mask_identifiers(F.col("text")).alias("masked"), t.contains_identifier(F.col("text")).alias("found"))


EMAIL = r"\b[\w.+-]+@[\w-]+\.[\w.-]+\b"


@query(
    "mask_emails",
    f"""select doc_id, md5(array_to_string([coalesce(z[1], '') || coalesce(case when length(z[2]) <= 4 then repeat('*', length(z[2])) else repeat('*', length(z[2]) - 4) || right(z[2], 4) end, '')
    for z in list_zip(regexp_split_to_array(text, '{EMAIL}'), regexp_extract_all(text, '{EMAIL}'))], '')) as masked_md5 from documents""",
)
def mask_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(t.mask_identifiers(F.col("text"), ("email",))).alias("masked_md5"))


@query("contains_identifier", "select doc_id, regexp_matches(text, '\\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\\.[A-Za-z0-9_.-]+\\b') as has_email from documents")
def contains_identifier(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.contains_identifier(F.col("text"), ("email",)).alias("has_email"))


@query("fingerprint", "select doc_id, left(sha256(text), 16) as fingerprint from documents")
def fingerprint(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.text_fingerprint(F.col("text")).alias("fingerprint"))


def sql_denial(c: str) -> str:
    marks = [DECLINE.lower().rstrip("."), *t.DENIALS]
    return "(" + " or ".join(f"contains(lower({c}), '{m}')" for m in marks) + ")"


@query("is_denial", f"select conv_id, turn, {sql_denial('answer')} as denial from (select *, case when turn % 3 = 0 then text || ' No consta.' else text end as answer from conversations where role = 'assistant')")
def is_denial(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    answer = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit(" No consta."))).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", t.is_denial(answer, DECLINE).alias("denial"))


@query("document_base", "select doc_id, split_part(regexp_replace('doc-' || doc_id || case when doc_id % 2 = 0 then '--003.md' else '.md' end, '\\.md$', ''), '--', 1) as base from documents")
def document_base(spark, sf):
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, "--003.md").otherwise(".md"))
    return table(spark, sf, "documents").select("doc_id", t.document_base(name).alias("base"))


@query("chunk_document_id", "select doc_id, case when n_chars < 2600 then 'doc-' || doc_id else printf('doc-%d--%03d', doc_id, n_chars // 2000) end as document_id from documents")
def chunk_document_id(spark, sf):
    docs = documents(spark, sf)
    index = F.floor(F.col("n_chars") / 2000).cast("int")
    return docs.select("doc_id", t.chunk_document_id(F.col("stem"), index, F.when(F.col("n_chars") < 2600, 1).otherwise(2)).alias("document_id"))


@query("citation", "select doc_id, coalesce(nullif(case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then source || '.pdf' end, ''), 'doc-' || doc_id) as citation from documents")
def citation(spark, sf):
    docs = documents(spark, sf)
    source = F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(".pdf")))
    return docs.select("doc_id", t.citation(source, F.col("stem")).alias("citation"))


@query(
    "is_grounded",
    f"""select conv_id, turn, contains(lower(a), '{DECLINE.lower().rstrip('.')}') or contains(a, '[doc-1]') or contains(a, '[doc-2]') as grounded
    from (select conv_id, turn, text || case turn % 4 when 1 then ' [doc-1]' when 2 then ' {DECLINE}' when 3 then ' [doc-3]' else '' end as a from conversations where role = 'assistant')""",
)
def is_grounded(spark, sf):
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    end = F.when(F.col("turn") % 4 == 1, " [doc-1]").when(F.col("turn") % 4 == 2, f" {DECLINE}").when(F.col("turn") % 4 == 3, " [doc-3]").otherwise("")
    return rows.select("conv_id", "turn", t.is_grounded(F.concat("text", end), F.array(F.lit("doc-1"), F.lit("doc-2")), DECLINE).alias("grounded"))


@query("collapsed_length", "select doc_id, length(regexp_replace(text, '[ \\t]+', ' ', 'g')) as n_collapsed from documents")
def collapsed_length(spark, sf):
    return table(spark, sf, "documents").select("doc_id", t.collapsed_length(F.col("text")).cast("long").alias("n_collapsed"))


@query("table_row_counts", "select doc_id, len([x for x in string_split(replace(text, '. ', ' |' || chr(10) || '| '), chr(10)) if regexp_full_match(x, '\\s*\\|.*\\|\\s*')]) as n_rows from documents")
def table_row_counts(spark, sf):
    tabled = F.replace("text", F.lit(". "), F.lit(" |\n| "))
    return table(spark, sf, "documents").select("doc_id", t.table_rows(tabled).cast("long").alias("n_rows"))


@query(
    "table_blocks",
    """with l as (select doc_id, unnest(x) as line, unnest(range(len(x))) as i from (select doc_id, string_split(replace(text, '. ', ' |' || chr(10) || '| '), chr(10)) as x from documents)),
    f as (select *, regexp_full_match(line, '\\s*\\|.*\\|\\s*') as r from l), g as (select *, r and not coalesce(lag(r) over (partition by doc_id order by i), false) as starts from f)
    select doc_id, count(*) filter (starts) as n_blocks from g group by doc_id""",
)
def table_blocks(spark, sf):
    tabled = F.replace("text", F.lit(". "), F.lit(" |\n| "))
    return table(spark, sf, "documents").select("doc_id", t.table_blocks(tabled).cast("long").alias("n_blocks"))


MARK = "case when contains(upper(text), 'PASSWORD') then 'password' when contains(upper(text), 'BEGIN PRIVATE KEY') then 'BEGIN PRIVATE KEY' when contains(upper(text), 'API_KEY') then 'api_key' end"


@query("banned_marker", f"select doc_id, {MARK} as marker from documents")
def banned_marker(spark, sf):
    return table(spark, sf, "documents").select("doc_id", p.banned_marker(F.col("text"), PUBLIC.banned_markers).alias("marker"))


@query("min_text_filter", "select doc_id, length(text) as n from documents where length(text) >= 200")
def min_text_filter(spark, sf):
    n = F.length("text").cast("long")
    return table(spark, sf, "documents").filter(n >= p.MIN_CHARS).select("doc_id", n.alias("n"))


STATUS = f"""(select doc_id, case when source = 'src3' then 'omitido' when doc_id % 97 = 0 then 'error' when {MARK} is not null then 'vetado' when length(text) < 200 then 'sin_texto' else 'ok' end as status,
 case when source = 'src3' then 'patrón' when doc_id % 97 = 0 then 'roto' when {MARK} is not null then {MARK} when length(text) < 200 then 'menos de 200 caracteres' end as reason, n_chars from documents)"""


@query("status_with_reason", f"select doc_id, status, reason from {STATUS}")
def status_with_reason(spark, sf):
    return _status(spark, sf).select("doc_id", "status", "reason")


def _status(spark, sf):
    docs = table(spark, sf, "documents")
    omitted = F.when(F.col("source") == "src3", "patrón")
    error = F.when(F.col("doc_id") % 97 == 0, "roto")
    s = p.status_with_reason(p.banned_marker(F.col("text"), PUBLIC.banned_markers), error, F.length("text"), omitted)
    return docs.withColumn("s", s).select("doc_id", "s.status", "s.reason", "n_chars")


@query("prep_report", f"select status, count(*) as n, cast(sum(n_chars) as bigint) as n_chars from {STATUS} group by status")
def prep_report(spark, sf):
    return _status(spark, sf).groupBy("status").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"))


@query("safe_document_name", "select doc_id, coalesce(length(s) between 1 and 255 and not regexp_matches(s, '[/\\\\\\x00]') and not starts_with(s, '.'), false) as safe from (select doc_id, case doc_id % 5 when 0 then '.' || source when 1 then source || '/x' when 2 then text else 'doc-' || doc_id || '.md' end as s from documents)")
def safe_document_name(spark, sf):
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit("."), "source")).when(k == 1, F.concat("source", F.lit("/x"))).when(k == 2, F.col("text")).otherwise(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".md")))
    return table(spark, sf, "documents").select("doc_id", p.safe_name(name).alias("safe"))


@query(
    "valid_conversations",
    """select conv_id, count(*) as n_turns, count(*) filter (role not in ('system', 'developer', 'user', 'assistant')) = 0 and count(*) filter (text is null) = 0 and count(*) filter (role in ('user', 'assistant')) > 0 as valid
    from conversations group by conv_id""",
)
def valid_conversations(spark, sf):
    return p.valid_conversations(table(spark, sf, "conversations")).select("conv_id", "n_turns", "valid")


@query("last_user_text", "select conv_id, coalesce(arg_max(text, turn) filter (role = 'user'), '') as last_user from conversations group by conv_id")
def last_user_text(spark, sf):
    turns = table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(F.coalesce(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), F.lit("")).alias("last_user"))


@query("system_turns", "select conv_id, turn, role, text from conversations where role in ('system', 'developer')")
def system_turns(spark, sf):
    return table(spark, sf, "conversations").filter(F.col("role").isin("system", "developer")).select("conv_id", "turn", "role", "text")


@query("dialogue", "select conv_id, count(*) as n, md5(string_agg(role || ':' || text, chr(10) order by turn)) as dialogue_md5 from conversations where role in ('user', 'assistant') group by conv_id")
def dialogue(spark, sf):
    turns = table(spark, sf, "conversations").filter(F.col("role").isin("user", "assistant"))
    rows = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(":", "role", "text").alias("line")))).alias("x"))
    return rows.select("conv_id", "n", F.md5(F.array_join(F.transform("x", lambda v: v["line"]), "\n")).alias("dialogue_md5"))


@query("unknown_fields", "select event_id, coalesce(array_to_string(list_sort([k for k in json_keys(props) if k not in ('ms', 'page')]), ','), '') as unknown from events")
def unknown_fields(spark, sf):
    return table(spark, sf, "events").select("event_id", F.array_join(p.unknown_fields(F.col("props"), ("ms", "page")), ",").alias("unknown"))
