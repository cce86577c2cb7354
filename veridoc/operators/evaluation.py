"""Checks of answers against golden questions, and comparison of two prepared corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import best_sentence, collapsed_length, document_base, fold, is_denial, table_blocks, table_rows
from veridoc.operators.tables import alignable

USD_PER_1000_PAGES = 15.0


def cited(expected: Column, answer: Column, documents: Column) -> Column:
    """Whether the answer names, in brackets, one of the retrieved chunks of the expected document."""
    base = document_base(expected)
    own = F.filter(documents, lambda d: document_base(d) == base)
    named = lambda c: F.contains(answer, F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.size(own) > 0, F.exists(own, named)).otherwise(named(expected))


def verdicts(rows: DataFrame) -> DataFrame:
    """Adds correct and reason to (kind, expected_doc, forbidden, answer, documents); the first rule decides."""
    answer, expected, documents = F.col("answer"), F.col("expected_doc"), F.col("documents")
    low, denied = F.lower(answer), is_denial(answer)
    leaked = F.exists(F.coalesce("forbidden", F.array().cast("array<string>")), lambda f: F.contains(low, F.lower(f)))
    has = F.coalesce(expected != "", F.lit(False))
    missed = has & ~F.exists(documents, lambda d: document_base(d) == document_base(expected))
    uncited = has & ~cited(expected, answer, documents)
    reason = (
        F.when(leaked, "leaked")
        .when(F.col("kind") == "negativa", F.when(denied, "denied").otherwise("not_denied"))
        .when(missed, "not_retrieved")
        .when(F.col("kind") == "enmascarada", F.when(uncited, "masked_uncited").otherwise("masked"))
        .when(denied & uncited, "denied_with_evidence")
        .when(uncited, "uncited")
        .otherwise("grounded")
    )
    return rows.withColumn("reason", reason).withColumn("correct", F.col("reason").isin("denied", "masked", "grounded"))


def upper_median(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value at position n div 2 of each key's sorted values; NaN and null do not count.

    Values are counted before they are shuffled; the window passes over the distinct ones of a key."""
    counts = rows.filter(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(key, value).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(key).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("_n").alias("_total"))
    reached = counts.withColumn("_to", F.sum("_n").over(order)).join(totals, F.equal_null(key, "_key")).filter(F.col("_to") > F.floor(F.col("_total") / 2))
    return reached.groupBy(key).agg(F.min(value).alias(value))


def eval_summary(judged: DataFrame) -> DataFrame:
    """Per model: correct answers, correct denials, and the upper median of the time to first token."""
    negative = F.col("kind") == "negativa"
    counts = judged.groupBy("model").agg(
        F.count_if("correct").alias("n_correct"),
        F.count("*").alias("n"),
        F.count_if(negative & F.col("correct")).alias("n_negative_correct"),
        F.count_if(negative).alias("n_negative"),
    )
    medians = upper_median(judged, "model", "ttft_s").select(F.col("model").alias("_model"), F.col("ttft_s").alias("ttft_p50"))
    return counts.join(medians, F.equal_null("model", "_model"), "left").drop("_model")


def eval_gate(judged: DataFrame) -> DataFrame:
    """One row: 1 if a negative question failed, else 2 if any did, else 0."""
    failed = F.count_if(~F.col("correct"))
    failed_negative = F.count_if(~F.col("correct") & (F.col("kind") == "negativa"))
    return judged.agg(F.when(failed_negative > 0, 1).when(failed > 0, 2).otherwise(0).alias("gate"))


def extractive_answer(rows: DataFrame, decline: str) -> DataFrame:
    """Adds answer to (query_tokens, hits): hits is an ordered array of (document_id, text), query_tokens are
    the folded words of the condensed question. A longer query word that no hit contains declines, and so does a
    question without hits (null or an empty array); the answer takes the first two hits."""
    tokens, hits = F.col("query_tokens"), F.col("hits")
    body = fold(F.array_join(F.transform(hits, lambda h: h["text"]), " "))
    # body stands in an array beside the tokens, so that it is folded once and not for each of them
    beside = F.zip_with(tokens, F.array_repeat(body, F.size(tokens)), lambda t, b: (F.length(t) >= 4) & ~F.contains(b, t))
    missing = F.exists(beside, lambda x: x)
    best = F.transform(F.slice(hits, 1, 2), lambda h: F.struct(best_sentence(tokens, h["text"]).alias("s"), h["document_id"].alias("d")))
    parts = F.transform(F.filter(best, lambda x: x["s"] != ""), lambda x: F.concat(F.regexp_replace(x["s"], r"\.+$", ""), F.lit(" ["), x["d"], F.lit("].")))
    said = F.concat(F.lit("Según los documentos disponibles: "), F.array_join(parts, " "))
    return rows.withColumn("answer", F.when(hits.isNull() | (F.size(hits) == 0) | missing | (F.size(parts) == 0), F.lit(decline)).otherwise(said))


def rebuild_docs(chunks: DataFrame) -> DataFrame:
    """(stem, n_chunks, text, n_chars, table_rows, table_blocks, origin, n_pages) of (stem, document_id, text, origin, n_pages)."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("document_id", "text"))), lambda x: x["text"])
    rows = chunks.groupBy("stem").agg(
        F.count("*").alias("n_chunks"),
        F.array_join(parts, "\n").alias("text"),
        F.min_by("origin", F.when(F.col("origin").isNotNull(), F.col("document_id"))).alias("origin"),
        F.max("n_pages").alias("n_pages"),
    )
    return rows.select("stem", "n_chunks", "text", collapsed_length(F.col("text")).alias("n_chars"), table_rows(F.col("text")).alias("table_rows"), table_blocks(F.col("text")).alias("table_blocks"), "origin", "n_pages")


def corpus_full_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stem, side, and each measure of both sides) of two sets of rebuilt documents."""
    measures = ["n_chunks", "n_chars", "table_rows", "table_blocks", "origin", "n_pages"]
    left = a.select("stem", *[F.col(m).alias(f"{m}_a") for m in measures], F.lit(True).alias("in_a"))
    right = b.select("stem", *[F.col(m).alias(f"{m}_b") for m in measures], F.lit(True).alias("in_b"))
    rows = left.join(right, "stem", "full_outer")
    side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both")
    return rows.withColumn("side", side).drop("in_a", "in_b")


def corpus_totals(docs: DataFrame, side: str) -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.sum("table_rows").alias("table_rows")).withColumn("side", F.lit(side))


def largest_divergence(joined: DataFrame, n: int = 10) -> DataFrame:
    """Common documents with the largest difference of characters."""
    delta = F.col("n_chars_b") - F.col("n_chars_a")
    rows = joined.filter("side = 'both'").select("stem", "n_chars_a", "n_chars_b", delta.alias("delta")).filter("delta != 0")
    return rows.orderBy(F.desc(F.abs("delta")), "stem").limit(n)


def table_winners(joined: DataFrame, n: int = 10) -> DataFrame:
    """For each side the documents in which it has most table rows more than the other."""
    gain = F.col("table_rows_b") - F.col("table_rows_a")
    rows = joined.filter("side = 'both'").withColumn("gain", F.abs(gain)).withColumn("winner", F.when(gain > 0, "b").when(gain < 0, "a")).filter("winner is not null")
    order = Window.partitionBy("winner").orderBy(F.desc("gain"), "stem")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n).select("winner", "place", "stem", "table_rows_a", "table_rows_b")


def coverage_gain(joined: DataFrame) -> DataFrame:
    """One row: documents that B reads without paid recognition and A does not, those that still need it, and
    what the pages saved would cost."""
    paid_a, paid_b = F.coalesce(F.col("origin_a").startswith("ocr:"), F.lit(False)), F.coalesce(F.col("origin_b").startswith("ocr:"), F.lit(False))
    both, only_b = F.col("side") == "both", F.col("side") == "only_b"
    rescued = (both & paid_a & ~paid_b) | (only_b & ~paid_b)
    pages = F.coalesce(F.sum(F.when(rescued & both, F.coalesce("n_pages_a", F.lit(0)))), F.lit(0))
    return joined.agg(
        F.count_if(rescued).alias("n_rescued"),
        F.count_if(both & paid_b).alias("n_still_paid"),
        F.count_if(F.col("side") == "only_a").alias("n_lost"),
        pages.alias("pages_saved"),
        F.round(pages / 1000 * USD_PER_1000_PAGES, 2).alias("usd_saved"),
    )


def conversion_totals(conversions: DataFrame) -> DataFrame:
    """One row of what conversions (seconds, pages, tables, one row a document) took: documents, pages, tables,
    seconds, and seconds a document; missing measures count as 0."""
    sums = {c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)) for c in ("pages", "tables", "seconds")}
    average = F.when(F.count("*") > 0, F.bround(sums["seconds"] / F.count("*"), 1))
    return conversions.agg(F.count("*").alias("n_docs"), *[v.alias(c) for c, v in sums.items()], average.alias("seconds_per_doc"))


def golden_join(golden: DataFrame, answers: DataFrame) -> DataFrame:
    """(id, kind, n_documents, expected_found) of golden questions (id, kind, expected_doc) with the documents that
    answers (id, documents) retrieved; a question without an answer has none."""
    held = F.coalesce("documents", F.array().cast("array<string>"))
    rows = golden.join(answers.select("id", "documents"), "id", "left")
    return rows.select("id", "kind", F.size(held).cast("long").alias("n_documents"), F.coalesce(F.array_contains(held, F.col("expected_doc")), F.lit(False)).alias("expected_found"))


def retrieval_bench(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """How well corpora answer questions (question_id, feature, version): one row for each corpus of hits.

    hits: (corpus, question_id, document_id, rank, text). A question is found where a hit's folded text holds its
    folded feature, and attributable where the first such hit has the feature in a table row under its version. As
    questions may stem from one of the corpora, the counts are also given over those that all of them found
    (n_common, attributable_common). A corpus without hits has no row; questions without hits count in total."""
    asked = questions.select("question_id", "feature", "version")
    holding = hits.join(asked, "question_id").filter(F.contains(fold(F.col("text")), fold(F.col("feature"))))
    first = holding.groupBy("corpus", "question_id").agg(F.min_by(F.struct("document_id", "text", "feature", "version"), "rank").alias("x")).select("corpus", "question_id", "x.*")
    # one text may be a hit of several questions, and a question has one hit of each corpus
    keyed = first.withColumn("question_id", F.struct("corpus", "question_id"))
    ok = alignable(keyed).select(F.col("question_id.corpus").alias("corpus"), F.col("question_id.question_id").alias("question_id"), "alignable")
    corpora = hits.select("corpus").distinct()
    everywhere = ok.groupBy("question_id").agg(F.count("*").alias("n")).join(corpora.agg(F.count("*").alias("n")), "n").select("question_id", F.lit(True).alias("common"))
    judged = ok.join(everywhere, "question_id", "left").withColumn("common", F.coalesce("common", F.lit(False)))
    counts = judged.groupBy("corpus").agg(
        F.count("*").alias("found"),
        F.count_if("alignable").alias("attributable"),
        F.count_if("common").alias("n_common"),
        F.count_if(F.col("common") & F.col("alignable")).alias("attributable_common"),
    )
    rows = corpora.join(counts, "corpus", "left").withColumn("total", F.lit(asked.count()).cast("long"))
    n = lambda c: F.coalesce(c, F.lit(0))
    share = lambda a, b: F.when(n(b) > 0, F.bround(100.0 * n(a) / n(b), 1)).otherwise(0.0)
    return rows.select(
        "corpus",
        "total",
        *[n(c).alias(c) for c in ("found", "attributable")],
        share("found", "total").alias("pct_found"),
        share("attributable", "total").alias("pct_attributable"),
        *[n(c).alias(c) for c in ("n_common", "attributable_common")],
        share("attributable_common", "n_common").alias("pct_common"),
    )


def doc_set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, stem): documents that only one corpus has, or both; each corpus is read once."""
    left, right = (d.select("stem").distinct().withColumn(n, F.lit(True)) for d, n in ((a, "in_a"), (b, "in_b")))
    side = F.when(F.col("in_b").isNull(), "only_a").when(F.col("in_a").isNull(), "only_b").otherwise("both")
    return left.join(right, "stem", "full_outer").select(side.alias("side"), "stem")


def line_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(stem, line, sign, n): lines that one corpus has more often than the other in the same document.

    Only documents whose texts differ send their lines on."""
    changed = a.select("stem", F.xxhash64("text").alias("ha")).join(b.select("stem", F.xxhash64("text").alias("hb")), "stem").filter("ha != hb").select("stem")
    lines = lambda d, n: d.join(changed, "stem", "left_semi").select("stem", F.explode(F.split("text", "\n")).alias("line"), F.lit(n).alias("n"))
    counts = lines(a, -1).unionByName(lines(b, 1)).groupBy("stem", "line").agg(F.sum("n").alias("d")).filter("d != 0")
    return counts.select("stem", "line", F.when(F.col("d") > 0, "+").otherwise("-").alias("sign"), F.abs("d").alias("n"))
