"""Page cleaning: noise lines, running headers and page numbers. All windows share one shuffle by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import lines, strip, strip_end
from veridoc.plans.policies import Cleanup

#: Lines that are noise, bare page numbers, and folios that say so.
NOISE = "^[A-Za-z0-9+/=]{60,}$"
BARE_NUMBER = r"^\s*[-–—]?\s*\d{1,3}\s*[-–—]?\s*$"
EXPLICIT_FOLIO = r"(?i)^\s*(p[áa]g(?:ina)?\.?)\s*\d+\s*(?:(?:de|/|of)\s*\d+)?\s*$"


def doc_lines(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, line_no, line) without blank and noise lines, line_no from 0 among those kept."""
    rows = pages.select("doc_id", "page_no", F.filter(F.transform(lines(F.col("text")), strip_end), lambda x: (strip(x) != "") & ~strip(x).rlike(NOISE)).alias("lines"))
    return rows.select("doc_id", "page_no", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line_no", "line"))


def _page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"))


def running_headers(lines: DataFrame, pages: DataFrame, policy: Cleanup = Cleanup()) -> DataFrame:  # noqa: B008
    """(doc_id, line, n_on): lines at the border of most pages of a document of several pages."""
    edge = (F.col("line_no") < policy.border_lines) | (F.col("line_no") >= F.col("n_lines") - policy.border_lines)
    border = lines.filter(edge & ~F.col("line").rlike(BARE_NUMBER)).select("doc_id", "page_no", "line").distinct()
    counts = border.groupBy("doc_id", "line").agg(F.count("*").alias("n_on"))
    least = F.greatest(F.lit(2), F.ceil(F.lit(float(policy.fraction)) * F.col("n_pages")))
    kept = counts.join(_page_counts(pages), "doc_id").filter((F.col("n_pages") >= policy.min_pages) & (F.col("n_on") >= least))
    return kept.select("doc_id", "line", "n_on")


def page_numbers(lines: DataFrame, policy: Cleanup = Cleanup()) -> DataFrame:  # noqa: B008
    """(doc_id, page_no, line_no): bare numbers first or last on their pages that rise over the document."""
    if policy.folio_border <= 0:
        return lines.select("doc_id", "page_no", "line_no").limit(0)
    found = lines.filter((F.col("n_lines") > policy.folio_border) & F.col("line").rlike(BARE_NUMBER))
    number = F.regexp_replace("line", "[^0-9]", "").cast("int")
    sides = found.filter("line_no = 0").withColumn("side", F.lit(0)).unionByName(found.filter("line_no = n_lines - 1").withColumn("side", F.lit(1)))
    order = Window.partitionBy("doc_id", "side").orderBy("page_no")
    every = Window.partitionBy("doc_id", "side")
    rows = sides.withColumn("value", number).withColumn("before", F.lag("value").over(order))
    rows = rows.withColumn("rises", F.min(F.coalesce(F.col("value") > F.col("before"), F.lit(True))).over(every)).withColumn("n", F.count("*").over(every))
    return rows.filter(F.col("rises") & (F.col("n") >= policy.min_pages)).select("doc_id", "page_no", "line_no").distinct()


def clean_pages(pages: DataFrame, policy: Cleanup = Cleanup()) -> DataFrame:  # noqa: B008
    """(doc_id, text): each document's lines without folios, running headers kept where they first appear."""
    lines = doc_lines(pages)
    total = _page_counts(pages)
    folios = page_numbers(lines, policy).withColumn("folio", F.lit(True))
    heads = running_headers(lines, pages, policy).select("doc_id", "line").withColumn("head", F.lit(True))
    rows = lines.join(folios, ["doc_id", "page_no", "line_no"], "left").join(total, "doc_id")
    rows = rows.filter(~(F.coalesce("folio", F.lit(False)) & (F.col("n_pages") >= policy.min_pages)) & ~F.col("line").rlike(EXPLICIT_FOLIO))
    rows = rows.join(heads, ["doc_id", "line"], "left")
    first = Window.partitionBy("doc_id", "line").orderBy("page_no", "line_no")
    rows = rows.withColumn("seen", F.when(F.col("head"), F.row_number().over(first)).otherwise(1)).filter("seen = 1")
    return rows.groupBy("doc_id").agg(strip(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_no", "line_no", "line"))), lambda x: x["line"]), "\n")).alias("text"))


def pages_override(pages: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(doc_id, page_no, text, reinforced): a page that was transcribed, and not as blank, replaces the native one."""
    better = strip(F.col("t_text")) != ""
    other = transcripts.select("doc_id", "page_no", F.col("text").alias("t_text"))
    rows = pages.join(other, ["doc_id", "page_no"], "left")
    return rows.select("doc_id", "page_no", F.when(better, F.col("t_text")).otherwise(F.col("text")).alias("text"), F.coalesce(better, F.lit(False)).alias("reinforced"))
