"""Evidence retrieval: lexical scores over an inverted index, vector scores in blocks, top-k receipts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veridoc.functions.text import chunk_text, citation, fold, plan_queries, token_set, with_tokens
from veridoc.functions.text import lines as lines_of
from veridoc.sources.shared import written

MIN_SCORE = 0.12
#: Query vectors that are multiplied by at a time; those that travel with a scan at most; and vectors in a slice.
QUERY_BLOCK, QUERY_CHUNK, SLICE_ROWS = 1024, 8192, 16_384
#: Tokens of all queries that travel with a scan of the chunks at most, and cells of chunks by queries that are counted at once.
QUERY_TERMS, COUNTED = 1 << 18, 1 << 22


def planned(questions: DataFrame, id_col: str = "question_id", text_col: str = "question") -> DataFrame:
    """(question_id, query_idx, query, tokens) of each question's variants; one of stop words only has no tokens,
    finds nothing and still stands in the receipt."""
    rows = questions.select(F.col(id_col).alias("question_id"), F.posexplode(plan_queries(F.col(text_col))).alias("query_idx", "query"))
    return rows.withColumn("tokens", token_set(F.col("query")))


def indexed(chunks: DataFrame) -> DataFrame:
    """(document_id, tokens) of chunks given as (document_id, text)."""
    return with_tokens(chunks.select("document_id", "text"), chunk_text(F.col("text"), F.col("document_id")), "text").withColumnRenamed("text", "tokens")


def lexical_score(queries: DataFrame, index: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """(question_id, query_idx, document_id, score): share of a query's tokens that a chunk has.

    Up to QUERY_CHUNK queries of QUERY_TERMS tokens travel with one scan of the chunks, which then are neither
    shuffled nor stored. More are joined: a score of min_score needs ceil(min_score * n) shared tokens, so the rarest
    n - that + 1 tokens of a query find every candidate; frequent tokens generate none, and candidates are verified
    on whole token sets. The index is read three times then.
    """
    if few(queries):
        return scanned(queries, index, min_score)
    index = written(index, "token-index")
    terms = query_terms(queries)
    wanted = terms.select("token").distinct()
    # only tokens that queries use leave the scan of the chunks
    postings = index.select("document_id", F.explode("tokens").alias("token")).join(wanted, "token", "left_semi")
    frequency = postings.groupBy("token").agg(F.count("*").alias("df"))
    candidates = probing_terms(terms, frequency, min_score).join(postings, "token").select("question_id", "query_idx", "document_id").distinct()
    return verified(queries, candidates, index, ["document_id"], min_score)


def few(queries: DataFrame) -> bool:
    """Whether queries are few enough to travel with a scan."""
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("terms")).first()
    return size["n"] <= QUERY_CHUNK and size["terms"] <= QUERY_TERMS


def scanned(queries: DataFrame, index: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """lexical_score of few queries: each chunk's tokens are looked up among theirs where they are read."""
    schema = ", ".join(f"{c} {dict([*queries.dtypes, *index.dtypes])[c]}" for c in ("question_id", "query_idx", "document_id"))
    asked = queries.select("question_id", "query_idx", "tokens").toArrow()
    if not len(asked):
        return queries.sparkSession.createDataFrame([], f"{schema}, score double")
    sizes = np.array([len(x or ()) for x in asked["tokens"].to_pylist()], np.int64)
    flat = pa.concat_arrays([c.flatten() for c in asked["tokens"].chunks])
    known = flat.unique()
    # queries of each token, one token after the other
    of = pc.index_in(flat, known).to_numpy(zero_copy_only=False).astype(np.int64)
    lists = np.repeat(np.arange(len(sizes)), sizes)[np.argsort(of, kind="stable")]
    ends = np.cumsum(np.bincount(of, minlength=len(known)))
    ids = [pa.concat_arrays(asked[c].chunks) for c in ("question_id", "query_idx")]
    held = max(1, COUNTED // max(1, len(sizes)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.append(0, ends)[:-1]
        for whole in batches:
            for b in (whole.slice(at, held) for at in range(0, whole.num_rows, held)):
                found = pc.index_in(b.column("tokens").flatten(), known)
                hit = found.is_valid().to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(b.num_rows), pc.fill_null(b.column("tokens").value_lengths(), 0).to_numpy(zero_copy_only=False))[hit]
                token = found.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
                n = ends[token] - starts[token]
                stops = np.cumsum(n)
                query = lists[np.repeat(starts[token] - stops + n, n) + np.arange(int(n.sum()))]
                shared = np.bincount(np.repeat(owner, n) * len(sizes) + query, minlength=b.num_rows * len(sizes)).reshape(b.num_rows, len(sizes))
                score = shared / np.maximum(sizes, 1)
                doc, query = np.nonzero((score >= min_score) & (shared > 0))
                yield pa.RecordBatch.from_arrays([*(x.take(pa.array(query)) for x in ids), b.column("document_id").take(pa.array(doc)), pa.array(score[doc, query])], ["question_id", "query_idx", "document_id", "score"])

    return index.select("document_id", "tokens").mapInArrow(scan, f"{schema}, score double")


def query_terms(queries: DataFrame) -> DataFrame:
    """(question_id, query_idx, n, token): each token of each query, and how many the query has."""
    return queries.select("question_id", "query_idx", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))


def probing_terms(terms: DataFrame, frequency: DataFrame, min_score: float) -> DataFrame:
    """terms without those that no candidate needs: a query's most frequent ones, by (token, df)."""
    rarest = Window.partitionBy("question_id", "query_idx").orderBy("df", "token")
    least = F.greatest(F.lit(1), F.ceil(F.lit(float(min_score)) * F.col("n") - 1e-9))
    ranked = terms.join(frequency, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))).withColumn("rank", F.row_number().over(rarest))
    return ranked.filter(F.col("rank") <= F.col("n") - least + 1).drop("n", "df", "rank")


def verified(queries: DataFrame, candidates: DataFrame, index: DataFrame, keys: list[str], min_score: float) -> DataFrame:
    """The score of each candidate by its whole token set, found in index by keys, if it is min_score or more."""
    pairs = candidates.join(queries.select("question_id", "query_idx", "tokens"), ["question_id", "query_idx"]).join(index.withColumnRenamed("tokens", "held"), keys)
    score = F.size(F.array_intersect("tokens", "held")) / F.size("tokens")
    return pairs.select("question_id", "query_idx", "document_id", score.alias("score")).filter(F.col("score") >= F.lit(float(min_score)))


def merge_hits(hits: DataFrame) -> DataFrame:
    """(question_id, document_id, score, query_idx): the best score over a question's variants, and the first
    variant that found the document at all."""
    return hits.groupBy("question_id", "document_id").agg(F.max("score").alias("score"), F.min("query_idx").alias("query_idx"))


def topk_hits(merged: DataFrame, k: int) -> DataFrame:
    """The k best of each question; ties go to the variant that passed first, then to the document order."""
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "query_idx", "document_id")
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def receipts(top: DataFrame, queries: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """(question_id, queries, results, documents, citations): what was asked and what came back, in order.

    sources gives (document_id, source) to cite by; without it documents are cited by their id."""
    named = top.join(sources, "document_id", "left") if sources is not None else top.withColumn("source", F.lit(None).cast("string"))
    named = named.withColumn("citation", citation(F.col("source"), F.col("document_id")))
    results = F.sort_array(F.collect_list(F.struct("rank", "document_id", F.bround("score", 4).alias("score"), "citation")))
    rows = named.groupBy("question_id").agg(results.alias("results"))
    asked = queries.groupBy("question_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("query_idx", "query"))), lambda q: q["query"]).alias("queries"))
    out = asked.join(rows, "question_id", "left")
    empty = F.lit(None).cast(rows.schema["results"].dataType)
    held = F.coalesce("results", F.filter(empty, lambda x: F.lit(True)), F.slice(F.array(F.struct(F.lit(0).alias("rank"), F.lit("").alias("document_id"), F.lit(0.0).alias("score"), F.lit("").alias("citation"))), 1, 0))
    out = out.withColumn("results", held)
    return out.withColumn("documents", F.array_distinct(F.transform("results", lambda r: r["document_id"]))).withColumn("citations", F.array_distinct(F.transform("results", lambda r: r["citation"])))


def vector_score(vectors: DataFrame, queries: DataFrame, k: int, floor: float | None = None, topic: str | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k vectors of largest cosine for each query, of its topic if named;
    of ties the smallest ids.

    vectors: (vec_id, embedding[, topic]); queries: (query_id, embedding[, topic]). Up to QUERY_CHUNK queries
    travel with the scan of the vectors, which then aren't shuffled. More are dealt in chunks of that size to slices
    of about SLICE_ROWS vectors, so what a task holds does not grow with either table. Either way queries meet
    vectors as matrix products, and only the k best of each batch or slice go on. A null or zero vector scores 0;
    rows without a topic match nothing where topics count.
    """
    keys = ["topic"] if topic else []
    pick = lambda df, name: df.select(F.col(name).alias("id"), "embedding", *(F.col(topic).alias(t) for t in keys)).filter(F.col("topic").isNotNull() if topic else F.lit(True))
    table, asked = pick(vectors, "vec_id"), pick(queries, "query_id")
    schema = f"query_id {dict(queries.dtypes)['query_id']}, vec_id {dict(vectors.dtypes)['vec_id']}, score double"
    n = asked.count()
    if n <= QUERY_CHUNK:
        few = asked.toArrow()

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matrices = _matrices(few, topic)
            for b in batches:
                yield from _best(pa.Table.from_batches([b]), matrices, k, topic)

        hits = table.mapInArrow(scan, schema)
    else:
        chunks, slices = -(-n // QUERY_CHUNK), max(1, -(-table.count() // SLICE_ROWS))
        numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        dealt = lambda n: F.pmod(F.xxhash64("id", "embedding"), F.lit(n)).cast("int")
        left = table.withColumn("slice", dealt(slices)).withColumn("chunk", numbers(chunks))
        right = asked.withColumn("chunk", dealt(chunks)).withColumn("slice", numbers(slices))
        by = ["slice", "chunk", *keys]

        def meet(some: pa.Table, wanted: pa.Table) -> pa.Table:
            arrow = pa.schema([("query_id", wanted["id"].type), ("vec_id", some["id"].type), ("score", pa.float64())])
            return pa.Table.from_batches(list(_best(some, _matrices(wanted, topic), k, topic)), arrow)

        hits = left.groupBy(by).cogroup(right.groupBy(by)).applyInArrow(meet, schema)
    if floor is not None:
        hits = hits.filter(F.col("score") >= floor)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _topics(rows: pa.Table, topic: str | None) -> Iterator[tuple[object, pa.Table]]:
    """Rows of each topic, in order of id; all rows if topics don't count."""
    rows = rows.sort_by("id")
    if topic is None:
        yield None, rows
    else:
        places: dict[object, list[int]] = {}
        for i, name in enumerate(rows["topic"].to_pylist()):
            places.setdefault(name, []).append(i)
        for name, at in places.items():
            yield name, rows.take(at)


def _matrices(queries: pa.Table, topic: str | None) -> dict[object, list[tuple[pa.Array, np.ndarray]]]:
    """For each topic its queries' ids and unit vectors, QUERY_BLOCK at a time."""
    found: dict[object, list] = {}
    for name, rows in _topics(queries, topic):
        parts = [rows.slice(at, QUERY_BLOCK) for at in range(0, rows.num_rows, QUERY_BLOCK)]
        found[name] = [(p["id"].combine_chunks(), _unit(p["embedding"].to_pylist())) for p in parts]
    return found


def _best(rows: pa.Table, matrices: dict, k: int, topic: str | None) -> Iterator[pa.RecordBatch]:
    for name, part in _topics(rows, topic):
        for asked, matrix in matrices.get(name, []) if part.num_rows else []:
            ids, most = part["id"].combine_chunks(), min(k, part.num_rows)
            scores = matrix @ _unit(part["embedding"].to_pylist(), matrix.shape[1]).T
            cut = np.partition(scores, -most, axis=1)[:, [-most]]
            above, level = scores > cut, scores == cut
            spare = most - above.sum(axis=1, keepdims=True)
            q, at = np.nonzero(above | (level & (np.cumsum(level, axis=1, dtype=np.int32) <= spare)))
            yield pa.RecordBatch.from_arrays([asked.take(pa.array(q)), ids.take(pa.array(at)), pa.array(scores[q, at])], ["query_id", "vec_id", "score"])


def _unit(rows: list, width: int | None = None) -> np.ndarray:
    width = width or next((len(r) for r in rows if r is not None), 1)
    table = np.array([r if r is not None else [0.0] * width for r in rows], np.float64)
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)


def citation_lines(text: Column, least: int = 14, most: int = 60) -> Column:
    """Normalised lines of a chunk that are worth finding on a page."""
    # folding keeps line ends, so a text is folded whole
    lines = F.transform(lines_of(fold(text)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.slice(F.array_distinct(F.filter(lines, lambda x: (F.length(x) >= least) & x.rlike("[a-z]{4}"))), 1, most)


def citation_locator(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, doc_id, page_no, hits): the page that holds most of a chunk's lines, the first on ties.

    chunks: (document_id, doc_id, text); pages: (doc_id, page_no, text). Pages after the first that holds all
    lines do not count."""
    # a chunk without lines has no hits; a filter on their number would make them twice
    wanted = chunks.select("document_id", "doc_id", citation_lines(F.col("text")).alias("lines"))
    flat = pages.select("doc_id", "page_no", F.regexp_replace(fold(F.col("text")), r"\s+", " ").alias("plain"))
    found = wanted.join(flat, "doc_id").withColumn("hits", F.size(F.filter("lines", lambda x: F.contains("plain", x)))).filter("hits > 0")
    every = Window.partitionBy("document_id", "doc_id")
    whole = F.min(F.when(F.col("hits") == F.size("lines"), F.col("page_no"))).over(every)
    kept = found.select("document_id", "doc_id", "page_no", "hits", whole.alias("whole")).filter(F.col("whole").isNull() | (F.col("page_no") <= F.col("whole")))
    best = every.orderBy(F.desc("hits"), "page_no")
    return kept.withColumn("r", F.row_number().over(best)).filter("r = 1").select("document_id", "doc_id", "page_no", "hits")
