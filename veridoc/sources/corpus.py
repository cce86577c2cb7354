"""Reading originals, prepared corpora and logs, and what is written back: corpus, manifest, sync plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.functions.text import document_base, slug, strip
from veridoc.sources.corpus_files import committed, read_files, write_files

TEXT_SUFFIXES = ("md", "markdown", "txt")
SIDECAR = ".metadata.json"


def read_originals(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("pdf", "xml", "json", "md", "markdown", "txt"), skip: tuple[str, ...] = ()) -> DataFrame:
    """(path, rel_path, extension, content) of files below root, without sidecars and skipped names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = root.rstrip("/").split("://")[-1].lstrip("/")
    rel = F.regexp_replace("path", f"^.*?{_quoted(base)}/", "")
    rows = files.select("path", rel.alias("rel_path"), F.lower(F.element_at(F.split("path", r"\."), -1)).alias("extension"), "content")
    rows = rows.filter(F.col("extension").isin(*extensions) & ~F.col("path").endswith(SIDECAR))
    for pattern in skip:
        rows = rows.filter(~F.col("rel_path").rlike(pattern))
    return rows


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else "\\" + c for c in literal)


def sidecar_metadata(raw: Column) -> Column:
    """String values of a sidecar: under metadataAttributes or flat; broken JSON gives an empty map."""
    flat = F.from_json(raw, "map<string,string>")
    nested = F.from_json(F.element_at(flat, "metadataAttributes"), "map<string,string>")
    return F.coalesce(nested, flat, F.create_map().cast("map<string,string>"))


def read_prepared_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(document_id, rel_path, text, metadata) of prepared text files and their optional sidecars: of those that the
    commits of write_corpus name, or of all files below root where there are no commits."""
    folders = committed(spark, root)
    if folders == []:
        return spark.createDataFrame([], "document_id string, rel_path string, text string, metadata map<string,string>")
    if folders:
        rows = read_files(spark, folders)
        return rows.select("document_id", F.col("path").alias("rel_path"), strip(F.col("text")).alias("text"), sidecar_metadata(F.col("sidecar")).alias("metadata"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.decode("content", "UTF-8").alias("text"))
    suffix = F.lower(F.element_at(F.split("path", r"\."), -1))
    texts = files.filter(suffix.isin(*TEXT_SUFFIXES)).select("path", strip(F.col("text")).alias("text"))
    side = files.filter(F.col("path").endswith(SIDECAR)).select(F.regexp_replace("path", r"\.metadata\.json$", "").alias("path"), F.col("text").alias("raw"))
    rows = texts.join(side, "path", "left")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("document_id"), F.col("path").alias("rel_path"), "text", sidecar_metadata(F.col("raw")).alias("metadata"))


def read_text_docs(spark: SparkSession, root: str) -> DataFrame:
    """Prepared texts that are not blank; a sidecar replaces the default metadata (type and source)."""
    rows = read_prepared_corpus(spark, root).filter("text != ''")
    default = F.create_map(F.lit("tipo"), F.lit("documento"), F.lit("fuente"), F.col("document_id"))
    return rows.withColumn("metadata", F.when(F.size("metadata") > 0, F.col("metadata")).otherwise(default))


_LICENSE = "Cedula struct<_numeroCedula:string,_fechaExpedicion:string,_entidadFederativa:string,_libroCedula:string,_fojaCedula:string,_numeroFojaLibro:string,_Tipo:string>, Profesionista struct<_nombre:string,_primerApellido:string,_segundoApellido:string,_curp:string>, Institucion struct<_nombreInstitucion:string>, Carrera struct<_nombreCarrera:string>"
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")


def parse_license_xml(rows: DataFrame, xml_col: str = "content") -> DataFrame:
    """(document_id, titular, carrera, institucion, numero, fecha, anio) of signed licences in XML text; other
    roots are left out."""
    raw = F.col(xml_col).cast("string")
    doc = F.from_xml(raw, _LICENSE, {"rowTag": "CedulaElectronica"})
    found = rows.filter(F.contains(raw, F.lit("<CedulaElectronica"))).withColumn("x", doc)
    day = F.to_date(F.split_part("x.Cedula._fechaExpedicion", F.lit(" "), F.lit(1)), "d/M/yyyy")
    career = F.concat(F.upper(F.left("x.Carrera._nombreCarrera", F.lit(1))), F.lower(F.substr("x.Carrera._nombreCarrera", F.lit(2))))
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month(day))
    return found.select(
        F.concat(F.lit("cedula-profesional-"), slug(career), F.lit("-"), F.year(day).cast("string"), F.lit(".md")).alias("document_id"),
        F.initcap(F.lower(F.concat_ws(" ", "x.Profesionista._nombre", "x.Profesionista._primerApellido", "x.Profesionista._segundoApellido"))).alias("titular"),
        career.alias("carrera"),
        F.initcap(F.lower("x.Institucion._nombreInstitucion")).alias("institucion"),
        F.col("x.Cedula._numeroCedula").alias("numero"),
        F.concat(F.dayofmonth(day).cast("string"), F.lit(" de "), month, F.lit(" de "), F.year(day).cast("string")).alias("fecha"),
        F.year(day).alias("anio"),
    )


_YEAR = "struct<totalCommitContributions:bigint,totalPullRequestContributions:bigint,totalRepositoriesWithContributedCommits:bigint>"


def parse_activity_json(rows: DataFrame, key: str, json_col: str = "content") -> DataFrame:
    """(key, year, commits, pull_requests, repositories) for each yearNNNN object of an activity export, whatever
    other fields stand beside them."""
    raw = F.col(json_col).cast("string")
    user = F.coalesce(F.get_json_object(raw, "$.data.user"), raw)
    years = F.filter(F.coalesce(F.json_object_keys(user), F.array().cast("array<string>")), lambda k: k.startswith("year"))
    held = F.from_json(user, "map<string,string>")
    rows = rows.select(key, F.explode(years).alias("_year_key"), held.alias("_held")).withColumn("_y", F.from_json(F.element_at("_held", F.col("_year_key")), _YEAR))
    count = lambda name: F.coalesce(F.col(f"_y.{name}"), F.lit(0))
    return rows.select(
        key,
        F.substr("_year_key", F.lit(5)).cast("int").alias("year"),
        count("totalCommitContributions").alias("commits"),
        count("totalPullRequestContributions").alias("pull_requests"),
        count("totalRepositoriesWithContributedCommits").alias("repositories"),
    )


def activity_totals(years: DataFrame, key: str) -> DataFrame:
    return years.groupBy(key).agg(F.sum("commits").alias("commits"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def parse_sse(streams: DataFrame, key: str, body: str = "body") -> DataFrame:
    """(key, frame_no, event, data) of server-sent event bodies; comments and empty frames are ignored, and
    data is null where it is no JSON, except for the closing mark."""
    frames = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n\n")
    rows = streams.select(key, F.posexplode(frames).alias("frame_no", "frame"))
    lines = F.filter(F.split("frame", "\n"), lambda x: ~x.startswith(":"))
    part = lambda name: F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(name + ":")), lambda x: F.ltrim(F.substr(x, F.lit(len(name) + 2)))), "\n")
    rows = rows.withColumn("event", part("event")).withColumn("data", part("data")).filter("data != ''")
    valid = (F.col("data") == "[DONE]") | F.try_parse_json("data").isNotNull()
    return rows.select(key, "frame_no", "event", F.when(valid, F.col("data")).alias("data")).filter("data is not null")


TELEMETRY = "ts timestamp, event string, request_id string, response_id string, profile string, model string, ttft_ms double, total_ms double, chunks int, latency_ms int, input_tokens long, output_tokens long, grounded boolean, error_type string, code string"


def read_event_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Telemetry lines (JSON; absent fields are null), as a batch or as a stream of files."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(TELEMETRY).json(path)


def read_golden(spark: SparkSession, questions: list[dict]) -> DataFrame:
    """Golden questions as rows; raises on repeated ids, positives without a document, or negatives that
    don't decline."""
    ids = [q["id"] for q in questions]
    if len(ids) != len(set(ids)):
        raise ValueError("question ids repeat")
    for q in questions:
        if q["tipo"] == "positiva" and not q.get("documento_esperado"):
            raise ValueError(f"{q['id']} expects no document")
        if q["tipo"] == "negativa" and not q.get("debe_declinar"):
            raise ValueError(f"{q['id']} must decline")
    rows = [(q["id"], q["pregunta"], q["tipo"], q.get("documento_esperado"), list(q.get("prohibido", []))) for q in questions]
    return spark.createDataFrame(rows, "id string, question string, kind string, expected_doc string, forbidden array<string>")


GOLDEN = "id string, pregunta string, tipo string, documento_esperado string, debe_declinar boolean, prohibido array<string>"
KINDS = ("positiva", "negativa", "enmascarada")


def read_golden_files(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions (id, question, kind, expected_doc, must_decline, forbidden) from files of JSON lines; nothing
    is left out, golden_problems tells what is wrong with them."""
    rows = spark.read.schema(GOLDEN).json(path)
    none = F.array().cast("array<string>")
    return rows.select("id", F.col("pregunta").alias("question"), F.col("tipo").alias("kind"), F.col("documento_esperado").alias("expected_doc"), F.coalesce("debe_declinar", F.lit(False)).alias("must_decline"), F.coalesce("prohibido", none).alias("forbidden"))


def golden_problems(golden: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, problem): what is wrong with golden questions, held against the documents (document_id) of a corpus.

    A chunk counts for the document that it is part of. A question may have several problems; rows with one id have
    that problem once, and rows without an id one each."""
    held = corpus.select(document_base(F.col("document_id")).alias("base")).distinct().withColumn("held", F.lit(True))
    rows = golden.withColumn("base", document_base(F.col("expected_doc"))).join(held, "base", "left")
    named = F.coalesce(F.col("expected_doc") != "", F.lit(False))
    rules = {
        "no_id": F.coalesce(F.col("id") == "", F.lit(True)),
        "no_question": F.coalesce(strip(F.col("question")) == "", F.lit(True)),
        "unknown_kind": ~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)),
        "expects_no_document": (F.col("kind") == "positiva") & ~named,
        "must_decline": (F.col("kind") == "negativa") & ~F.col("must_decline"),
        "not_in_corpus": named & F.col("held").isNull(),
    }
    each = F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    found = rows.select("id", F.explode(each).alias("problem"))
    repeated = golden.filter("id != ''").groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id", F.lit("repeated_id").alias("problem"))
    return found.unionByName(repeated)


def prefer_xml(originals: DataFrame) -> DataFrame:
    """Originals without the PDFs that have an XML of the same stem beside them."""
    kind = F.lower(F.element_at(F.split("path", r"\."), -1))
    stem = F.regexp_replace("path", r"\.[^./]+$", "")
    rows = originals.withColumn("_kind", kind).withColumn("_stem", stem)
    xml = rows.filter("_kind = 'xml'").select("_stem").distinct().withColumn("_pdf", F.lit("pdf"))
    return rows.join(xml, (rows["_stem"] == xml["_stem"]) & (rows["_kind"] == xml["_pdf"]), "left_anti").drop("_kind", "_stem")


def cache_key(engine: Column, dpi: Column, pages: Column, content: Column) -> Column:
    """Key of paid work on a file: what the work depends on, and the file's bytes."""
    head = F.concat_ws("|", F.lit("v3"), engine, dpi.cast("string"), pages.cast("string"), F.lit(""))
    return F.substring(F.sha2(F.concat(F.encode(head, "UTF-8"), content), 256), 1, 32)


def pending_work(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Work (with key) that the cache does not hold."""
    return wanted.join(cached.select("key").distinct(), "key", "left_anti")


def id_collisions(rows: DataFrame) -> DataFrame:
    """(document_id, n_paths) of ids that several paths produce."""
    return rows.groupBy("document_id").agg(F.count_distinct("path").alias("n_paths")).filter("n_paths > 1")


#: Metadata keys that a manifest may have, for each becomes a column.
MOST_KEYS = 1000


def manifest(rows: DataFrame, most_keys: int = MOST_KEYS) -> DataFrame:
    """One flat row for each chunk: fixed columns, then every other metadata key in order, '' where absent. Raises
    where the rows have more than most_keys different ones."""
    keys = sorted(r[0] for r in rows.select(F.explode(F.map_keys("extra"))).distinct().limit(most_keys + 2).collect() if r[0] != "fragmentos_totales")
    if len(keys) > most_keys:
        raise ValueError(f"a manifest can have {most_keys} metadata keys at most")
    fixed = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in ("tipo", "anio", "fuente") else F.col(c) for c in ("document_id", "tipo", "anio", "fuente", "caracteres")]
    return rows.select(*fixed, *[F.coalesce(F.element_at("extra", k), F.lit("")).alias(k) for k in keys])


def sync_plan(prepared: DataFrame, published: DataFrame, key: str, banned: Column | None = None) -> DataFrame:
    """(key, action): what mirroring the prepared corpus changes. Only hashes are shuffled. Raises if a
    prepared text is banned or none is left."""
    if banned is not None and not prepared.filter(banned.isNotNull()).isEmpty():
        raise ValueError("the prepared corpus holds banned text")
    if prepared.isEmpty():
        raise ValueError("there is nothing to publish")
    digest = lambda d, n: d.select(key, F.sha2(F.col("text"), 256).alias(n))
    both = digest(prepared, "new").join(digest(published, "old"), key, "full_outer")
    action = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").when(F.col("new") != F.col("old"), "changed").otherwise("same")
    return both.select(key, action.alias("action"))


def write_corpus(chunks: DataFrame, root: str, profile: str, masks: bool, allowed_root: str, overwrite: bool = True) -> None:
    """Writes chunks (document_id, text, metadata map) as text files with sidecars below root; each sidecar names the
    profile. A profile that masks may only be written below its allowed root, which is checked first."""
    if masks and not (root.rstrip("/") + "/").startswith(allowed_root.rstrip("/") + "/"):
        raise ValueError(f"{profile} may not be written to {root}")
    told = F.map_concat(F.map_filter(F.coalesce("metadata", F.create_map().cast("map<string,string>")), lambda k, v: k != "perfil"), F.create_map(F.lit("perfil"), F.lit(profile)))
    write_files(chunks.withColumn("metadata", told), root, overwrite)
