"""The given tables in the roles that the plans use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Lines of a document that make a page of the page-level plans.
PAGE_LINES = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with a path and a stem."""
    docs = table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.withColumn("stem", stem).withColumn("path", F.concat_ws("/", "source", "lang", F.concat(stem, F.lit(".md"))))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_no, text): lines of documents, PAGE_LINES to a page."""
    return _parts(table(spark, sf_dir, "documents").select("doc_id", "text"), PAGE_LINES, "page_no").drop("n_parts")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stem, document_id, chunk_index, chunk_total, text): documents' lines, eight to a chunk."""
    return chunked(documents(spark, sf_dir))


def chunked(docs: DataFrame) -> DataFrame:
    """chunk_table of documents (stem, text)."""
    rows = _parts(docs.select("stem", "text"), 8, "at").withColumn("chunk_index", F.col("at") + 1)
    return rows.select("stem", F.format_string("%s--%03d.md", "stem", "chunk_index").alias("document_id"), "chunk_index", F.col("n_parts").alias("chunk_total"), "text")


def _parts(docs: DataFrame, size: int, name: str) -> DataFrame:
    """docs with their text's lines, so many to a row, numbered from 0, and how many such parts the text has.

    A text is cut where it is read and nothing is shuffled, unless rows share their keys: then the lines of equal
    number stand together in one part, as in SQL that groups by keys and part."""
    keys = [c for c in docs.columns if c != "text"]
    if docs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        cut = F.regexp_extract_all(F.concat(F.lit("\n"), "text"), F.lit(f"(?:\\n[^\\n]*){{1,{size}}}"), F.lit(0))
        rows = docs.select(*keys, cut.alias("cut")).select(*keys, F.size("cut").alias("n_parts"), F.posexplode("cut").alias(name, "part"))
        return rows.select(*keys, "n_parts", name, F.substr("part", F.lit(2)).alias("text"))
    split = docs.withColumn("lines", F.split("text", "\n"))
    rows = split.select(*keys, F.ceil(F.size("lines") / size).cast("int").alias("n_parts"), F.posexplode("lines").alias("i", "line"))
    parts = rows.groupBy(*keys, "n_parts", F.floor(F.col("i") / size).cast("int").alias(name)).agg(F.sort_array(F.collect_list(F.struct("i", "line"))).alias("x"))
    return parts.select(*keys, "n_parts", name, F.array_join(F.transform("x", lambda v: v["line"]), "\n").alias("text"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, question): the benchmark's texts."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))
