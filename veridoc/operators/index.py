"""Index cards: families and periods of documents, representative samples, and change detection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Families by pattern of the slug, in order.
FAMILIES = (
    (r"^\d[tT]\d\d", "reporte-trimestral"),
    (r"^cnbv-", "reporte-anual"),
    (r"^reporte-anual-", "reporte-anual"),
    (r"^informe-anual-", "reporte-anual"),
    (r"^eeff-", "estados-financieros"),
    (r"^(?:.+-)?(?:mzo|jun|sep|dic)\d\d-balance", "balance-mensual"),
    (r"^estado-de-situacin-", "estado-situacion"),
)
MONTHS = {"mzo": "Marzo", "jun": "Junio", "sep": "Septiembre", "dic": "Diciembre"}
#: Slugs that begin with a year after a prefix.
YEARLY = (r"^informe-anual-integrado-(\d{4})", r"^cnbv-n-(\d{4})", r"^reporte-anual-anexo-n-(\d{4})")


def doc_family(slug: Column) -> Column:
    rule = F.lit("documento")
    for pattern, family in reversed(FAMILIES):
        rule = F.when(slug.rlike(pattern), F.lit(family)).otherwise(rule)
    return rule


def _found(c: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def doc_period(slug: Column) -> Column:
    """The period that a slug names, or null."""
    # fixed values: slugs that name a quarter, a month, a quarter in words or a year
    quarter = r"^(\d)t(\d\d)"
    month = r"^(?:.+-)?(mzo|jun|sep|dic)(\d\d)-balance"
    names = F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])
    labels = [
        F.concat(_found(slug, quarter, 1), F.lit("T"), _found(slug, quarter, 2)),
        F.concat(F.element_at(names, _found(slug, month, 1)), F.lit(" 20"), _found(slug, month, 2)),
        *[_found(slug, p) for p in YEARLY],
        F.upper(_found(slug, r"^estado-de-situacin-financiera-(\d[tT]\d\d)")),
        _found(slug, r"^eeff-(\d{4})"),
    ]
    return F.coalesce(*labels)


def family_rollup(docs: DataFrame) -> DataFrame:
    """Per family of (slug, n_chunks): documents, chunks, and first and last year and quarter."""
    rows = docs.withColumn("family", doc_family(F.col("slug"))).withColumn("period", doc_period(F.col("slug")))
    year = F.coalesce(_found(F.col("period"), r"((?:19|20)\d{2})"), F.concat(F.lit("20"), _found(F.col("period"), r"^\dT(\d{2})$"))).cast("int")
    quarter = _found(F.col("period"), r"^(\d)T\d{2}$").cast("int")
    rows = rows.withColumn("year", year).withColumn("quarter", quarter)
    order = F.when(F.col("quarter").isNotNull(), F.struct("year", "quarter"))
    return rows.groupBy("family").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_chunks").alias("n_chunks"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min_by("period", order).alias("first_quarter"),
        F.max_by("period", order).alias("last_quarter"),
    )


def sample_fragments(chunks: DataFrame, n: int = 8) -> DataFrame:
    """Representative chunks of each stem: its first ones, two cuts inside and the last; all if there are few."""
    order = Window.partitionBy("stem").orderBy("chunk_index")
    rows = chunks.withColumn("at", F.row_number().over(order) - 1).withColumn("total", F.count("*").over(Window.partitionBy("stem")))
    first = max(1, n * 6 // 10)
    at, total = F.col("at"), F.col("total")
    chosen = (total <= n) | (at < first) | (at == F.floor(total / 3)) | (at == F.floor(2 * total / 3)) | (at == total - 1)
    return rows.filter(chosen).drop("at", "total")


def sample_hash(sample: DataFrame) -> DataFrame:
    """(stem, sample_hash): SHA-256 over names and texts of a stem's sampled chunks, in order, each ended by a zero."""
    zero = F.lit("\0")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "document_id", "text"))), lambda x: F.concat(x["document_id"], zero, x["text"], zero))
    return sample.groupBy("stem").agg(F.sha2(F.array_join(parts, ""), 256).alias("sample_hash"))


@F.pandas_udf(T.StringType())
def extract_json_object(answers: pd.Series) -> pd.Series:
    """The first balanced {...} of each answer, without code fences; null where none closes."""

    def first(text: str | None) -> str | None:
        if text is None:
            return None
        body = text.strip()
        if body.startswith("```"):
            body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
        depth = np.cumsum([(c == "{") - (c == "}") for c in body]) if body else np.zeros(0)
        start = body.find("{")
        if start < 0:
            return None
        base = depth[start] - 1
        ends = np.flatnonzero(depth[start:] == base)
        return body[start : start + int(ends[0]) + 1] if len(ends) else None

    return answers.map(first)


def index_check(cards: DataFrame) -> DataFrame:
    """(name, ok, problem) of cards (name, text, metadata_json)."""
    size = F.octet_length("text")
    problem = (
        F.when(F.col("metadata_json").isNull(), "no_metadata")
        .when((size <= 400) | (size >= 8000), "size")
        .when(F.contains("name", F.lit("--")), "looks_like_a_chunk")
    )
    return cards.select("name", problem.isNull().alias("ok"), problem.alias("problem"))


def index_reached(questions: DataFrame, hits: DataFrame, cards: DataFrame, k: int = 5) -> DataFrame:
    """(question_id, n_cards, ok) of every question: the index cards (name) among its first k hits (question_id,
    document_id, rank), and whether there is one."""
    found = hits.filter(F.col("rank") <= k).join(cards.select(F.col("name").alias("document_id")).distinct(), "document_id", "left_semi")
    counts = found.groupBy("question_id").agg(F.count("*").alias("n_cards"))
    rows = questions.select("question_id").join(counts, "question_id", "left").withColumn("n_cards", F.coalesce("n_cards", F.lit(0)))
    return rows.select("question_id", "n_cards", (F.col("n_cards") > 0).alias("ok"))
