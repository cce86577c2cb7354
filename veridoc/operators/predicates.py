"""Rules that keep, drop, classify or report documents, turns and pages."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.functions.text import doc_type, slug, strip, year_in
from veridoc.plans.policies import Documents

#: Floors for extracted and transcribed text, and what makes a page a scan.
MIN_CHARS, MIN_DENSITY, MAX_PAGES = 200, 200, 40
SCAN_CHARS, SCAN_COVER = 120, 0.60
ROLES = ("system", "developer", "user", "assistant")


def banned_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """The first marker, in declared order, that the text contains in any case; else null."""
    if not markers:
        return F.lit(None).cast("string")
    upper = F.upper(text)
    return F.coalesce(*[F.when(F.contains(upper, F.lit(m.upper())), F.lit(m)) for m in markers])


def glob_pattern(glob: str) -> str:
    """Anchored regular expression of a glob whose * also crosses slashes."""
    return "^(?s)" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob) + "$"


def classify(path: Column, kind: Column, text: Column, policy: Documents) -> Column:
    """Class of a document: markers of all classes first, then paths, then types, each in declared order."""
    upper, rule = F.upper(text), F.lit(None).cast("string")
    tests = [(F.contains(upper, F.lit(m.upper())), c.name) for c in policy.classes for m in c.markers]
    tests += [(path.rlike(glob_pattern(g)), c.name) for c in policy.classes for g in c.paths]
    tests += [(kind == t, c.name) for c in policy.classes for t in c.types]
    for test, name in reversed(tests):
        rule = F.when(test, F.lit(name)).otherwise(rule)
    return F.coalesce(rule, F.lit(policy.default))


def exposed(document_class: Column, policy: Documents) -> Column:
    return F.coalesce(document_class.isin(*policy.exposes), F.lit(False)) if policy.exposes else F.lit(False)


def status_with_reason(marker: Column, error: Column, n_chars: Column, omitted: Column, least: int = MIN_CHARS) -> Column:
    """One status and its reason for every file: omitted, failed, vetoed, too little text, or ok."""
    status = lambda s, r: F.struct(F.lit(s).alias("status"), r.alias("reason"))
    return (
        F.when(omitted.isNotNull(), status("omitido", omitted))
        .when(error.isNotNull(), status("error", error))
        .when(marker.isNotNull(), status("vetado", marker))
        .when(F.coalesce(n_chars, F.lit(0)) < least, status("sin_texto", F.concat(F.lit("menos de "), F.lit(str(least)), F.lit(" caracteres"))))
        .otherwise(status("ok", F.lit(None).cast("string")))
    )


def density_gate(pages: DataFrame, least: int = MIN_DENSITY) -> DataFrame:
    """(doc_id, n_pages, n_chars, dense) of transcribed pages; joined pages count their joints."""
    filled = strip(F.col("text")) != ""
    chars = F.sum(F.when(filled, F.length(strip(F.col("text")))).otherwise(0)) + F.greatest(2 * (F.count_if(filled) - 1), F.lit(0))
    rows = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), chars.alias("n_chars"))
    return rows.withColumn("dense", F.col("n_chars") / F.greatest("n_pages", F.lit(1)) >= least)


def transcript_completeness(requested: DataFrame, returned: DataFrame, cap: int = MAX_PAGES) -> DataFrame:
    """(doc_id, n_requested, n_returned, complete, over_cap): only complete transcripts may be kept for reuse."""
    asked = requested.groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    got = returned.groupBy("doc_id").agg(F.count("*").alias("n_returned"))
    rows = asked.join(got, "doc_id", "left").withColumn("n_returned", F.coalesce("n_returned", F.lit(0)))
    rows = rows.withColumn("n_requested", F.least("n_pages", F.lit(cap)))
    return rows.select("doc_id", "n_requested", "n_returned", (F.col("n_returned") >= F.col("n_requested")).alias("complete"), (F.col("n_pages") > cap).alias("over_cap"))


def scanned(n_chars: Column, image_cover: Column) -> Column:
    return (n_chars < SCAN_CHARS) & (image_cover > SCAN_COVER)


def select_pages(signals: DataFrame, detected: DataFrame | None, mode: str = "con-tablas") -> DataFrame:
    """Rows of page signals that need structured extraction; without a detector's output, all of them."""
    if mode == "todas" or (mode == "con-tablas" and detected is None):
        return signals
    if mode != "con-tablas":
        return signals.limit(0)
    found = detected.filter("n_columns >= 2 and n_cells >= 6").select("doc_id", "page_no").distinct().withColumn("_table", F.lit(True))
    joined = signals.join(found, ["doc_id", "page_no"], "left")
    return joined.filter(scanned(F.col("n_chars"), F.col("image_cover")) | (F.col("h_rules") >= 1) | F.col("_table")).drop("_table")


def safe_name(name: Column) -> Column:
    """Whether a document's name is a plain file name."""
    length = F.length(name)
    return F.coalesce((length >= 1) & (length <= 255) & ~name.rlike(r"[/\\\x00]") & ~name.startswith("."), F.lit(False))


def valid_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, valid, reason): known roles only, and one turn of a user or assistant at least."""
    known = F.coalesce(F.col("role").isin(*ROLES), F.lit(False))
    rows = turns.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"),
        F.count_if(~known).alias("unknown"),
        F.count_if(F.col("role").isin("user", "assistant")).alias("spoken"),
        F.count_if(F.col("text").isNull()).alias("untexted"),
    )
    reason = F.when(F.col("unknown") > 0, "unknown_role").when(F.col("untexted") > 0, "non_text_content").when(F.col("spoken") == 0, "no_dialogue")
    return rows.select("conv_id", "n_turns", reason.isNull().alias("valid"), reason.alias("reason"))


def doc_metadata(docs: DataFrame, conversion: DataFrame, engine: str = "motor") -> DataFrame:
    """What each prepared document says of itself: name, text under its title, and metadata as columns.

    docs: (stem, file_name, text); conversion: (stem, n_pages, n_structured, transcribed, encrypted, confidence) of
    how its text came about: n_structured pages were replaced by the engine's, or the engine transcribed the whole
    file. Absent facts are null; a document without a conversion counts as its own text layer."""
    rows = docs.join(conversion, "stem", "left")
    structured = F.coalesce("n_structured", F.lit(0))
    origin = (
        F.when(F.coalesce("transcribed", F.lit(False)), F.lit(f"ocr:{engine}"))
        .when(structured > 0, F.format_string("capa de texto + %s (%d/%d páginas)", F.lit(engine), structured, F.col("n_pages")))
        .otherwise(F.lit("capa de texto"))
    )
    return rows.select(
        "stem",
        F.concat(slug(F.col("stem")), F.lit(".md")).alias("document_id"),
        F.concat(F.lit("# "), F.col("stem"), F.lit("\n\n"), F.col("text"), F.lit("\n")).alias("text"),
        doc_type(F.col("stem")).alias("tipo"),
        F.col("file_name").alias("fuente"),
        F.col("n_pages").alias("paginas"),
        origin.alias("origen_texto"),
        F.when(F.col("encrypted"), F.lit(True)).alias("cifrado_original"),
        F.col("confidence").alias("ocr_confianza"),
        F.when(structured > 0, structured).alias("paginas_con_estructura"),
        year_in(slug(F.col("stem"))).alias("anio"),
    )


def unknown_fields(body: Column, known: tuple[str, ...]) -> Column:
    """Sorted top-level keys of a JSON object that the contract does not name."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(body), F.array().cast("array<string>")), F.array(*map(F.lit, known))))
