"""Queries that prepare and compare corpora: pages, chunks, manifests, joins and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from veridoc.functions import text as t
from veridoc.operators import chunking, cleaning, evaluation, index, predicates
from veridoc.operators.kept_cards import KeptCards
from veridoc.plans.inputs import PAGE_LINES, chunk_table, chunked, documents, pages, table
from veridoc.plans.policies import PRIVATE, PUBLIC
from veridoc.plans.text_plans import sql_slug
from veridoc.sources.shared import shared_dir, written

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


RAW_LINES = "(select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents)"
PAGES = f"(select doc_id, i // {PAGE_LINES} as page_no, string_agg(line, chr(10) order by i) as text from {RAW_LINES} group by all)"
#: Pages with a running line on each, and a folio that rises.
STAMPED_SQL = f"""(select doc_id, page_no, 'Documento ' || doc_id || chr(10) || text || chr(10) || (page_no + 1) as text from {PAGES})"""
LINES = f"""(select doc_id, page_no, line, count(*) over (partition by doc_id, page_no) as n_lines, row_number() over (partition by doc_id, page_no order by i) - 1 as line_no
 from (select doc_id, page_no, rtrim(unnest(string_split(text, chr(10)))) as line, unnest(range(len(string_split(text, chr(10))))) as i from {STAMPED_SQL})
 where trim(line) <> '' and not regexp_full_match(trim(line), '[A-Za-z0-9+/=]{{60,}}'))"""
NUMBER = "\\s*[-–—]?\\s*[0-9]{1,3}\\s*[-–—]?\\s*"


def stamped(spark, sf):
    rows = pages(spark, sf)
    return rows.withColumn("text", F.concat(F.lit("Documento "), F.col("doc_id").cast("string"), F.lit("\n"), "text", F.lit("\n"), (F.col("page_no") + 1).cast("string")))


@query("doc_lines", f"select doc_id, page_no, line_no, md5(line) as line_md5 from {LINES}")
def doc_lines(spark, sf):
    return cleaning.doc_lines(stamped(spark, sf)).select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"), F.md5("line").alias("line_md5"))


HEADS = f"""(select c.doc_id, line, n_on from (select doc_id, line, count(distinct page_no) as n_on from {LINES} where (line_no < 3 or line_no >= n_lines - 3) and not regexp_full_match(line, '{NUMBER}') group by all) c
 join (select doc_id, count(*) as n_pages from {PAGES} group by all) p on p.doc_id = c.doc_id where n_pages >= 3 and n_on >= greatest(2, ceil(0.6::double * n_pages)))"""
FOLIOS = f"""(select distinct doc_id, page_no, line_no from (select *, min(case when v > b or b is null then 1 else 0 end) over (partition by doc_id, side) as rises, count(*) over (partition by doc_id, side) as n
 from (select *, lag(v) over (partition by doc_id, side order by page_no) as b from (select doc_id, page_no, line_no, cast(regexp_replace(line, '[^0-9]', '', 'g') as int) as v, s.side from {LINES} l, (values (0), (1)) s(side)
 where n_lines > 1 and regexp_full_match(line, '{NUMBER}') and ((s.side = 0 and line_no = 0) or (s.side = 1 and line_no = n_lines - 1))))) where rises = 1 and n >= 3)"""


@query("running_headers", f"select doc_id, line, n_on from {HEADS}")
def running_headers(spark, sf):
    raw = stamped(spark, sf)
    return cleaning.running_headers(cleaning.doc_lines(raw), raw)


@query("page_numbers", f"select doc_id, page_no, line_no from {FOLIOS}")
def page_numbers(spark, sf):
    return cleaning.page_numbers(cleaning.doc_lines(stamped(spark, sf))).select("doc_id", "page_no", F.col("line_no").cast("long").alias("line_no"))


@query(
    "clean_pages",
    f"""select doc_id, md5(trim(string_agg(line, chr(10) order by page_no, line_no))) as text_md5 from (select l.*, case when h.line is not null then row_number() over (partition by l.doc_id, l.line order by l.page_no, l.line_no) else 1 end as seen
    from {LINES} l join (select doc_id, count(*) as n_pages from {PAGES} group by all) p on p.doc_id = l.doc_id left join {FOLIOS} f on f.doc_id = l.doc_id and f.page_no = l.page_no and f.line_no = l.line_no
    left join {HEADS} h on h.doc_id = l.doc_id and h.line = l.line where not (f.doc_id is not null and n_pages >= 3) and not regexp_full_match(lower(l.line), '\\s*p[áa]g(ina)?\\.?\\s*[0-9]+\\s*((de|/|of)\\s*[0-9]+)?\\s*')) where seen = 1 group by doc_id""",
)
def clean_pages(spark, sf):
    return cleaning.clean_pages(stamped(spark, sf)).select("doc_id", F.md5("text").alias("text_md5"))


TRANSCRIPTS = f"(select doc_id, page_no, case when (doc_id + page_no) % 3 = 0 then '  ' else replace(text, 'e', 'E') end as text from {PAGES} where (doc_id + page_no) % 2 = 0)"


def _transcripts(spark, sf):
    k = F.col("doc_id") + F.col("page_no")
    return pages(spark, sf).filter(k % 2 == 0).withColumn("text", F.when(k % 3 == 0, "  ").otherwise(F.replace("text", F.lit("e"), F.lit("E"))))


@query(
    "pages_override",
    f"select p.doc_id, p.page_no, md5(case when trim(t.text) <> '' then t.text else p.text end) as text_md5, coalesce(trim(t.text) <> '', false) as reinforced from {PAGES} p left join {TRANSCRIPTS} t on t.doc_id = p.doc_id and t.page_no = p.page_no",
)
def pages_override(spark, sf):
    rows = cleaning.pages_override(pages(spark, sf), _transcripts(spark, sf))
    return rows.select("doc_id", F.col("page_no").cast("long").alias("page_no"), F.md5("text").alias("text_md5"), "reinforced")


@query(
    "doc_metadata",
    f"""with d as (select *, 'Ficha técnica ' || (1980 + doc_id % 60) || ' ' || source || ' ' || doc_id as stem from documents), n as (select doc_id, count(*) as n_pages from {PAGES} group by 1),
    r as (select p.doc_id, count(*) filter (trim(t.text) <> '') as k from {PAGES} p join {TRANSCRIPTS} t on t.doc_id = p.doc_id and t.page_no = p.page_no group by 1)
    select {sql_slug('stem')} || '.md' as document_id, md5('# ' || stem || chr(10) || chr(10) || text || chr(10)) as text_md5, 'ficha_tecnica' as tipo, stem || '.pdf' as fuente, n_pages as paginas,
    case when d.doc_id % 4 = 0 then 'ocr:motor' when coalesce(k, 0) > 0 then printf('capa de texto + motor (%d/%d páginas)', k, n_pages) else 'capa de texto' end as origen_texto,
    case when d.doc_id % 9 = 0 then true end as cifrado_original, case when d.doc_id % 4 = 0 then round_even(90 + (d.doc_id % 97) / 10.0, 1)::double end as ocr_confianza, case when k > 0 then k end as paginas_con_estructura, 1980 + doc_year as anio
    from (select *, doc_id % 60 as doc_year from d) d left join n on n.doc_id = d.doc_id left join r on r.doc_id = d.doc_id""",
)
def doc_metadata(spark, sf):
    """Metadata of documents whose pages were counted and partly transcribed."""
    k = F.col("doc_id")
    named = table(spark, sf, "documents").withColumn("stem", F.concat_ws(" ", F.lit("Ficha técnica"), (k % 60 + 1980).cast("string"), "source", k.cast("string")))
    rows = cleaning.pages_override(pages(spark, sf), _transcripts(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if("reinforced").alias("n_structured"))
    facts = named.select("doc_id", "stem").join(rows, "doc_id", "left").select("stem", "n_pages", "n_structured", (k % 4 == 0).alias("transcribed"), (k % 9 == 0).alias("encrypted"), F.when(k % 4 == 0, F.bround(90 + (k % 97) / 10.0, 1)).alias("confidence"))
    out = predicates.doc_metadata(named.select("stem", F.concat("stem", F.lit(".pdf")).alias("file_name"), "text"), facts)
    return out.withColumn("text_md5", F.md5("text")).withColumn("anio", F.col("anio").cast("long")).drop("stem", "text")


#: As TRANSCRIPTS, of every page: blank ones stay as rows.
ALL_TRANSCRIPTS = f"(select doc_id, page_no, case when (doc_id + page_no) % 3 = 0 then '  ' else replace(text, 'e', 'E') end as text from {PAGES})"


DENSITY = (
    f"""select doc_id, n_pages, cast(chars + greatest(2 * (filled - 1), 0) as bigint) as n_chars, (chars + greatest(2 * (filled - 1), 0)) / n_pages >= 200 as dense
    from (select doc_id, count(*) as n_pages, count(*) filter (trim(text) <> '') as filled, sum(length(trim(text))) as chars from {ALL_TRANSCRIPTS} group by doc_id)"""
)


@query("density_gate", DENSITY)
@query("density_gate_all", DENSITY)
def density_gate(spark, sf):
    """Over every page of every document (under two names, an older one had every other page)."""
    blank = (F.col("doc_id") + F.col("page_no")) % 3 == 0
    return predicates.density_gate(pages(spark, sf).withColumn("text", F.when(blank, "  ").otherwise(F.replace("text", F.lit("e"), F.lit("E")))))


@query("transcript_completeness", f"select a.doc_id, least(a.n, 40) as n_requested, coalesce(b.n, 0) as n_returned, coalesce(b.n, 0) >= least(a.n, 40) as complete, a.n > 40 as over_cap from (select doc_id, count(*) as n from {PAGES} group by 1) a left join (select doc_id, count(*) as n from {TRANSCRIPTS} group by 1) b on a.doc_id = b.doc_id")
def transcript_completeness(spark, sf):
    return predicates.transcript_completeness(pages(spark, sf), _transcripts(spark, sf))


SIGNALS = f"(select doc_id, page_no, length(text) as n_chars, (doc_id % 10) / 10.0 as image_cover, case when doc_id % 11 = 0 then 1 else 0 end as h_rules from {PAGES})"


def _signals(spark, sf):
    return pages(spark, sf).select("doc_id", "page_no", F.length("text").cast("long").alias("n_chars"), (F.col("doc_id") % 10 / 10.0).alias("image_cover"), F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0).alias("h_rules"))


@query("select_pages", f"select doc_id, page_no from {SIGNALS} where (n_chars < 120 and image_cover > 0.60) or h_rules >= 1 or (doc_id % 7 = 0 and page_no = 0)")
def select_pages(spark, sf):
    signals = _signals(spark, sf)
    detected = signals.filter("doc_id % 7 = 0 and page_no <= 1").select("doc_id", "page_no", F.lit(2).alias("n_columns"), F.when(F.col("page_no") == 0, 6).otherwise(5).alias("n_cells"))
    return predicates.select_pages(signals, detected).select("doc_id", F.col("page_no").cast("long").alias("page_no"))


@query("page_cap", f"select doc_id, page_no from (select *, row_number() over (partition by doc_id order by page_no) as r from {SIGNALS}) where r <= 3")
def page_cap(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("page_no")
    return _signals(spark, sf).withColumn("r", F.row_number().over(order)).filter("r <= 3").select("doc_id", F.col("page_no").cast("long").alias("page_no"))


@query("chunk_documents")
def chunk_documents(spark, sf):
    docs = documents(spark, sf).select("doc_id", "stem", "text")
    return chunking.chunk_documents(docs, PUBLIC.chunking).select("doc_id", "document_id", "chunk_index", "chunk_total", "chunk_text")


CHUNKS = f"(select 'doc-' || doc_id as stem, doc_id, printf('doc-%d--%03d.md', doc_id, cast(i // 8 + 1 as int)) as document_id, i // 8 + 1 as chunk_index, string_agg(line, chr(10) order by i) as text from {RAW_LINES} group by all)"
#: Lines of documents, eight to a chunk, with how many chunks the document has.
LINE_CHUNKS = "(select *, count(*) over (partition by stem) as chunk_total from {CHUNKS})"


@query("chunk_rows", f"select document_id, md5(text) as text_md5, case when chunk_total > 1 then chunk_index end as fragmento, case when chunk_total > 1 then chunk_total end as fragmentos_totales, true as contiene_pii from {LINE_CHUNKS}".replace("{CHUNKS}", CHUNKS))
def chunk_rows(spark, sf):
    """Every chunk of every document, eight lines each; chunk_rows_all has those of the chunker."""
    rows = chunking.chunk_rows(chunk_table(spark, sf), masks=bool(PRIVATE.redaction))
    return rows.select("document_id", F.md5("text").alias("text_md5"), F.col("fragmento").cast("long").alias("fragmento"), F.col("fragmentos_totales").cast("long").alias("fragmentos_totales"), "contiene_pii")


def _chunk_rows(spark, sf, *columns):
    docs = documents(spark, sf).select("doc_id", "stem", "text", *columns)
    return chunking.chunk_rows(chunking.chunk_documents(docs, PUBLIC.chunking), masks=bool(PRIVATE.redaction))


@query("chunk_rows_all")
def chunk_rows_all(spark, sf):
    """Every chunk that the chunker makes of every document, with its number and total."""
    rows = _chunk_rows(spark, sf)
    return rows.select("doc_id", "document_id", F.md5("chunk_text").alias("text_md5"), "fragmento", "fragmentos_totales", "contiene_pii")


@query(
    "manifest",
    f"""select document_id, 'documento' as tipo, '' as anio, source || '.pdf' as fuente, cast(length(c.text) as bigint) as caracteres, lang as idioma, case when c.doc_id % 2 = 0 then source else '' end as origen,
    case when chunk_total > 1 then cast(chunk_index as varchar) else '' end as fragmento from {LINE_CHUNKS} c join documents d on d.doc_id = c.doc_id""".replace("{CHUNKS}", CHUNKS),
)
def manifest(spark, sf):
    """A row for each chunk of eight lines; manifest_chunks has those of the chunker."""
    from veridoc.sources.corpus import manifest as build

    about = documents(spark, sf).select("stem", "doc_id", "lang", "source")
    rows = chunking.chunk_rows(chunk_table(spark, sf), masks=False).join(about, "stem")
    held = {"idioma": F.col("lang"), "origen": F.when(F.col("doc_id") % 2 == 0, F.col("source")), **{c: F.col(c).cast("string") for c in ("fragmento", "fragmentos_totales")}}
    extra = F.map_filter(F.create_map(*[x for k, v in held.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return build(rows.select("document_id", t.doc_type(F.col("stem")).alias("tipo"), F.lit(None).cast("int").alias("anio"), F.concat("source", F.lit(".pdf")).alias("fuente"), F.length("text").cast("long").alias("caracteres"), extra.alias("extra")))


@query(
    "corpus_round_trip",
    f"""select document_id, md5(trim(c.text, ' ' || chr(9) || chr(10) || chr(13))) as text_md5, 'publico' as perfil, lang as idioma, cast(chunk_index as varchar) as fragmento, case when c.doc_id % 2 = 0 then source end as origen
    from {LINE_CHUNKS} c join documents d on d.doc_id = c.doc_id""".replace("{CHUNKS}", CHUNKS),
)
def corpus_round_trip(spark, sf):
    """Chunks of eight lines written as a corpus of files and read back from its commit."""
    from veridoc.sources import corpus

    about = documents(spark, sf).select("stem", "doc_id", "lang", "source")
    rows = chunk_table(spark, sf).join(about, "stem")
    held = F.map_filter(F.create_map(F.lit("idioma"), F.col("lang"), F.lit("fragmento"), F.col("chunk_index").cast("string"), F.lit("origen"), F.when(F.col("doc_id") % 2 == 0, F.col("source"))), lambda k, v: v.isNotNull())
    root = shared_dir(spark, "corpus")
    corpus.write_corpus(rows.select("document_id", "text", held.alias("metadata")), root, PUBLIC.slug, bool(PUBLIC.redaction), root)
    back = corpus.read_prepared_corpus(spark, root)
    return back.select("document_id", F.md5("text").alias("text_md5"), *[F.element_at("metadata", k).alias(k) for k in ("perfil", "idioma", "fragmento", "origen")])


@query("manifest_chunks")
def manifest_chunks(spark, sf):
    """The manifest of the chunker's chunks."""
    from veridoc.sources.corpus import manifest as build

    rows = _chunk_rows(spark, sf, "lang", "source")
    held = {"idioma": F.col("lang"), "origen": F.when(F.col("doc_id") % 2 == 0, F.col("source")), **{c: F.col(c).cast("string") for c in ("fragmento", "fragmentos_totales", "contiene_pii")}}
    extra = F.map_filter(F.create_map(*[x for k, v in held.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    flat = rows.select("document_id", t.doc_type(F.col("stem")).alias("tipo"), F.lit(None).cast("int").alias("anio"), F.concat("source", F.lit(".pdf")).alias("fuente"), F.length("chunk_text").cast("long").alias("caracteres"), extra.alias("extra"))
    # documents are chunked once; the manifest reads the rows twice
    return build(written(flat, "manifest-rows"))


@query(
    "sync_plan",
    """select coalesce(a.doc_id, b.doc_id) as doc_id, case when b.doc_id is null then 'new' when a.doc_id is null then 'deleted' when a.h <> b.h then 'changed' else 'same' end as action
    from (select doc_id, md5(text) as h from documents where doc_id % 10 <> 3) a full outer join (select doc_id, md5(case when doc_id % 7 = 0 then text || '!' else text end) as h from documents where doc_id % 10 <> 4) b on a.doc_id = b.doc_id""",
)
def sync_plan(spark, sf):
    from veridoc.sources.corpus import sync_plan as plan

    docs = table(spark, sf, "documents").select("doc_id", "text")
    old = docs.filter("doc_id % 10 != 4").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return plan(docs.filter("doc_id % 10 != 3"), old, "doc_id")


@query("prefer_xml", "select doc_id from documents d where not (doc_id % 2 = 0 and exists (select 1 from documents x where x.doc_id = d.doc_id + 1 and x.lang = 'en'))")
def prefer_xml(spark, sf):
    from veridoc.sources.corpus import prefer_xml as prefer

    docs = table(spark, sf, "documents")
    stem = F.floor(F.col("doc_id") / 2).cast("string")
    kind = F.when(F.col("doc_id") % 2 == 0, ".pdf").when(F.col("lang") == "en", ".xml").otherwise(".txt")
    return prefer(docs.select("doc_id", F.concat(stem, kind).alias("path"))).select("doc_id")


PENDING = "select count(*) as n_pending, cast(sum(n_pages) as bigint) as n_pages, sum(n_pages) / 1000 * 15.0 as usd from (select left(sha256('v3|motor|200|' || n_pages || '|' || text), 32) as key, n_pages, doc_id from (select *, cast(ceil(n_chars / 2000) as bigint) as n_pages from documents)) w where not exists (select 1 from (select left(sha256('v3|motor|200|' || cast(ceil(n_chars / 2000) as bigint) || '|' || text), 32) as key from documents where doc_id % 3 = 0) c where c.key = w.key)"


@query("pending_work", PENDING)
@query("pending_work_all", PENDING)
def pending_work(spark, sf):
    """Pending work among documents of every length (under two names, an older one had short ones); the cache holds a
    third of them."""
    from veridoc.sources.corpus import cache_key, pending_work as pending

    docs = table(spark, sf, "documents").withColumn("n_pages", F.ceil(F.col("n_chars") / 2000))
    keyed = docs.select("doc_id", "n_pages", cache_key(F.lit("motor"), F.lit(200), F.col("n_pages"), F.encode("text", "UTF-8")).alias("key"))
    work = pending(keyed, keyed.filter("doc_id % 3 = 0"))
    return work.agg(F.count("*").alias("n_pending"), F.sum("n_pages").alias("n_pages"), (F.sum("n_pages") / 1000 * 15.0).alias("usd"))


@query("id_collisions", "select source as document_id, count(distinct lang) as n_paths from documents group by 1 having count(distinct lang) > 1")
def id_collisions(spark, sf):
    from veridoc.sources.corpus import id_collisions as collisions

    return collisions(table(spark, sf, "documents").select(F.col("source").alias("document_id"), F.col("lang").alias("path")))


@query("ocr_confidence", "select doc_id, round_even(avg(c), 1) as confidence from (select doc_id, page_no, round_even(avg(c), 1) as c from (select doc_id, i // 4 as page_no, cast(90 + (i // 4) % 10 as double) as c from " + RAW_LINES + ") group by all) group by doc_id")
def ocr_confidence(spark, sf):
    from veridoc.operators.tables import ocr_confidence as confidence

    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return confidence(lines.select("doc_id", F.floor(F.col("i") / PAGE_LINES).alias("page_no"), (90 + F.floor(F.col("i") / PAGE_LINES) % 10).cast("double").alias("confidence")))


SIDE = "select 'doc-' || doc_id as stem, count(*) as n_chunks, string_agg({text}, chr(10) order by document_id) as text, min(doc_id) as doc_id from " + CHUNKS + " where {where} group by doc_id"
ROWS_OF = "len([x for x in string_split(text, chr(10)) if regexp_full_match(x, '\\s*\\|.*\\|\\s*')])"
SIDE_A = "(select *, length(regexp_replace(text, '[ \\t]+', ' ', 'g')) as n_chars, " + ROWS_OF + " as table_rows from (" + SIDE.format(text="text", where="doc_id % 10 <> 1") + "))"
SIDE_B = "(select *, length(regexp_replace(text, '[ \\t]+', ' ', 'g')) as n_chars, " + ROWS_OF + " as table_rows from (" + SIDE.format(text="case when doc_id % 4 = 0 then '| ' || replace(text, chr(10), ' |' || chr(10) || '| ') || ' |' else text end", where="doc_id % 10 <> 2") + "))"


def _side(spark, sf, b: bool):
    rows = chunk_table(spark, sf).withColumn("doc_id", F.split_part("stem", F.lit("-"), F.lit(2)).cast("long"))
    rows = rows.filter(F.col("doc_id") % 10 != (2 if b else 1))
    origin = F.when(F.col("doc_id") % (9 if b else 5) == 0, "ocr:motor").otherwise("capa de texto")
    if b:
        barred = F.concat(F.lit("| "), F.replace("text", F.lit("\n"), F.lit(" |\n| ")), F.lit(" |"))
        rows = rows.withColumn("text", F.when(F.col("doc_id") % 4 == 0, barred).otherwise(F.col("text")))
    return evaluation.rebuild_docs(rows.withColumn("origin", origin).withColumn("n_pages", F.col("doc_id") % 13))


@query("rebuild_docs", f"select stem, n_chunks, md5(text) as text_md5, n_chars, table_rows from {SIDE_B}")
def rebuild_docs(spark, sf):
    return _side(spark, sf, True).select("stem", "n_chunks", F.md5("text").alias("text_md5"), "n_chars", "table_rows")


@query("corpus_full_join", f"select coalesce(a.stem, b.stem) as stem, case when b.stem is null then 'only_a' when a.stem is null then 'only_b' else 'both' end as side, a.n_chars as n_chars_a, b.n_chars as n_chars_b from {SIDE_A} a full outer join {SIDE_B} b on a.stem = b.stem")
def corpus_full_join(spark, sf):
    return _joined(spark, sf).select("stem", "side", "n_chars_a", "n_chars_b")


def _joined(spark, sf):
    return evaluation.corpus_full_join(_side(spark, sf, False), _side(spark, sf, True))


@query("corpus_totals", " union all ".join(f"select '{n}' as side, count(*) as n_docs, cast(sum(n_chunks) as bigint) as n_chunks, cast(sum(n_chars) as bigint) as n_chars, cast(sum(table_rows) as bigint) as table_rows from {s}" for n, s in (("a", SIDE_A), ("b", SIDE_B))))
def corpus_totals(spark, sf):
    return evaluation.corpus_totals(_side(spark, sf, False), "a").unionByName(evaluation.corpus_totals(_side(spark, sf, True), "b"))


BOTH = f"(select a.stem, a.doc_id, a.n_chars as n_chars_a, b.n_chars as n_chars_b, a.table_rows as table_rows_a, b.table_rows as table_rows_b from {SIDE_A} a join {SIDE_B} b on a.stem = b.stem)"


@query("largest_divergence", f"select stem, n_chars_a, n_chars_b, n_chars_b - n_chars_a as delta from {BOTH} where n_chars_a <> n_chars_b order by abs(n_chars_b - n_chars_a) desc, stem limit 10")
def largest_divergence(spark, sf):
    return evaluation.largest_divergence(_joined(spark, sf))


@query("table_winners", f"select winner, place, stem, table_rows_a, table_rows_b from (select *, row_number() over (partition by winner order by abs(table_rows_b - table_rows_a) desc, stem) as place from (select *, case when table_rows_b > table_rows_a then 'b' when table_rows_a > table_rows_b then 'a' end as winner from {BOTH}) where winner is not null) where place <= 10")
def table_winners(spark, sf):
    return evaluation.table_winners(_joined(spark, sf))


@query(
    "coverage_gain",
    """select count(*) filter (r) as n_rescued, count(*) filter (a and b and pb) as n_still_paid, count(*) filter (a and not b) as n_lost, cast(coalesce(sum(doc_id % 13) filter (r and a), 0) as bigint) as pages_saved, round(coalesce(sum(doc_id % 13) filter (r and a), 0) / 1000 * 15.0, 2) as usd_saved
    from (select *, (a and b and pa and not pb) or (b and not a and not pb) as r from (select doc_id, doc_id % 10 <> 1 as a, doc_id % 10 <> 2 as b, doc_id % 5 = 0 as pa, doc_id % 9 = 0 as pb from documents))""",
)
def coverage_gain(spark, sf):
    return evaluation.coverage_gain(_joined(spark, sf))


@query("doc_set_diff", "select 'only_a' as side, 'doc-' || doc_id as stem from documents where doc_id % 10 = 2 union all select 'only_b', 'doc-' || doc_id from documents where doc_id % 10 = 1 union all select 'both', 'doc-' || doc_id from documents where doc_id % 10 not in (1, 2)")
def doc_set_diff(spark, sf):
    return evaluation.doc_set_diff(_side(spark, sf, False), _side(spark, sf, True))


@query(
    "line_diff",
    f"""with l as (select stem, unnest(string_split(text, chr(10))) as line, -1 as n from {SIDE_A} where stem in (select stem from {SIDE_B}) union all select stem, unnest(string_split(text, chr(10))), 1 from {SIDE_B} where stem in (select stem from {SIDE_A}))
    select stem, md5(line) as line_md5, case when sum(n) > 0 then '+' else '-' end as sign, cast(abs(sum(n)) as bigint) as n from l group by stem, line having sum(n) <> 0""",
)
def line_diff(spark, sf):
    return evaluation.line_diff(_side(spark, sf, False), _side(spark, sf, True)).select("stem", F.md5("line").alias("line_md5"), "sign", "n")


@query("slowest_docs", "select doc_id, n_chars / 1000 as seconds from documents order by seconds desc, doc_id limit 3")
def slowest_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 1000).alias("seconds")).orderBy(F.desc("seconds"), "doc_id").limit(3)


@query(
    "conversion_totals",
    "select count(*) as n_docs, sum(n_pages) as pages, sum(n_tables) as tables, sum(n_chars) as seconds, round_even(sum(n_chars) / count(*), 1) as seconds_per_doc from (select n_chars, doc_id % 7 as n_pages, case when doc_id % 3 = 0 then 0 else doc_id % 5 end as n_tables from documents)",
)
def conversion_totals(spark, sf):
    """Documents whose conversion took a second for each character."""
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select((d % 7).alias("pages"), F.when(d % 3 != 0, d % 5).alias("tables"), F.col("n_chars").alias("seconds"))
    return evaluation.conversion_totals(rows)


@query(
    "sample_fragments",
    f"""select stem, chunk_index from (select stem, chunk_index, row_number() over (partition by stem order by chunk_index) - 1 as pos, count(*) over (partition by stem) as total from {CHUNKS})
    where total <= 4 or pos < 2 or pos = total // 3 or pos = 2 * total // 3 or pos = total - 1""",
)
def sample_fragments(spark, sf):
    return index.sample_fragments(chunk_table(spark, sf), 4).select("stem", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(
    "sample_hash",
    f"""select stem, sha256(string_agg(document_id || chr(0) || text || chr(0), '' order by chunk_index)) as sample_hash from (select *, row_number() over (partition by stem order by chunk_index) - 1 as pos, count(*) over (partition by stem) as total from {CHUNKS})
    where total <= 4 or pos < 2 or pos = total // 3 or pos = 2 * total // 3 or pos = total - 1 group by stem""",
)
def sample_hash(spark, sf):
    return index.sample_hash(index.sample_fragments(chunk_table(spark, sf), 4))


@query(
    "cards_refreshed",
    """select * from (values (1, 'made', (select count(*) from documents where doc_id % 10 <> 3) + (select count(*) from documents where doc_id % 25 = 1)), (1, 'kept', 0), (1, 'removed', 0),
    (2, 'made', (select count(*) from documents where doc_id % 10 = 3 or doc_id % 50 = 7)), (2, 'kept', (select count(*) from documents where doc_id % 10 <> 3 and doc_id % 50 <> 7)),
    (2, 'removed', (select count(*) from documents where doc_id % 10 <> 3 and doc_id % 50 = 7) + (select count(*) from documents where doc_id % 25 = 1)),
    (3, 'made', 0), (3, 'kept', (select count(*) from documents)), (3, 'removed', 0), (3, 'cards', (select count(*) from documents))) t(step, what, n)""",
)
def cards_refreshed(spark, sf):
    """Cards of an older state of the documents, of today's, and of today's again: only what changed is made."""
    docs = documents(spark, sf)
    k = F.col("doc_id")
    old = docs.filter(k % 10 != 3).withColumn("text", F.when(k % 50 == 7, F.concat(F.lit("antigua "), "text")).otherwise(F.col("text")))
    gone = docs.filter(k % 25 == 1).withColumn("stem", F.concat(F.lit("retired-"), "stem"))
    kept = KeptCards(spark, shared_dir(spark, "cards"))
    make = lambda chunks: chunks.groupBy("stem").agg(F.concat_ws(" ", F.lit("card"), F.count("*").cast("string")).alias("card"))
    steps = [old.unionByName(gone), docs, docs]
    rows = [(i, w, n) for i, d in enumerate(steps, 1) for w, n in kept.refresh(index.sample_fragments(chunked(d), 4), make).items()]
    held = kept.cards().agg(F.lit(3).alias("step"), F.lit("cards").alias("what"), F.count("*").alias("n"))
    return spark.createDataFrame(rows, "step int, what string, n long").unionByName(held)


@query(
    "family_rollup",
    """with d as (select *, doc_id % 6 as k, n_chars // 2000 + 1 as chunks from documents),
    r as (select case when k = 0 then 'reporte-trimestral' when k = 1 then 'reporte-anual' when k = 2 then 'estados-financieros' when k = 3 then 'balance-mensual' else 'estado-situacion' end as family, chunks,
     case when k = 1 or k = 2 then 2000 + doc_id % 25 else 2000 + doc_id % 20 end as year, case when k = 0 or k > 3 then doc_id % 4 + 1 end as quarter from d)
    select family, count(*) as n_docs, cast(sum(chunks) as bigint) as n_chunks, cast(min(year) as integer) as first_year, cast(max(year) as integer) as last_year,
    min(printf('%dT%02d', quarter, year - 2000) ) filter (quarter is not null and (year, quarter) = f) as first_quarter, min(printf('%dT%02d', quarter, year - 2000)) filter (quarter is not null and (year, quarter) = l) as last_quarter
    from (select *, min((year, quarter)) filter (quarter is not null) over (partition by family) as f, max((year, quarter)) filter (quarter is not null) over (partition by family) as l from r) group by family""",
)
def family_rollup(spark, sf):
    docs = table(spark, sf, "documents")
    k = F.col("doc_id") % 6
    slug = (
        F.when(k == 0, F.format_string("%dt%02d-reporte", F.col("doc_id") % 4 + 1, F.col("doc_id") % 20))
        .when(k == 1, F.format_string("cnbv-n-%d", 2000 + F.col("doc_id") % 25))
        .when(k == 2, F.format_string("eeff-%d", 2000 + F.col("doc_id") % 25))
        .when(k == 3, F.format_string("banco-mzo%02d-balance", F.col("doc_id") % 20))
        .otherwise(F.format_string("estado-de-situacin-financiera-%dt%02d", F.col("doc_id") % 4 + 1, F.col("doc_id") % 20))
    )
    return index.family_rollup(docs.select(slug.alias("slug"), (F.floor(F.col("n_chars") / 2000) + 1).alias("n_chunks")))

