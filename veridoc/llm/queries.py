"""The training-data queries over the given tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridoc.llm import alignment, chat, common, fingerprints, importance, licenses, media, near_dedup, packing, piece_bpe, simple8b, spelling, token_counts, toxicity

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_with_edits(table(spark, sf_dir, "documents"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def op3_chunked_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_media(spark, media.store_media(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    limit = toxicity.threshold(net)
    return toxicity.with_score(docs.select("doc_id", "text", "lang"), net).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        limit.alias("lang_threshold"),
        (F.col("score") >= limit).alias("rejected"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """Packs whole documents by their tokens and an end token each: a row for each piece of each document.

    Null and empty texts have their end token only; a text beyond the largest sequence is cut into pieces; repeated
    rows and rows without an id are packed each by itself, equal lengths by ascending id; other columns are left out;
    an empty table gives no rows."""
    counts = token_counts.count_tokens(docs, tokenizer_path(BYTE_BPE))
    return packing.pack_documents(counts.select("doc_id", (F.col("n_tokens") + 1).alias("n_tokens")))


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sample = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", sample), (-1, 1, "assistant", sample)], turns.schema)
    windows = chat.format_windows(turns.unionByName(extra), tokenizer_path(BYTE_BPE))
    return chat.window_digests(common.stored(windows, "chat-windows"))


def op9_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = piece_bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_BPE))
    return rows.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = common.shared_dir(spark, "token-files")
    index = simple8b.write_token_files(table(spark, sf_dir, "documents"), root, tokenizer_path(BYTE_BPE), end_id=2)
    return simple8b.with_crc(simple8b.read_token_files(spark, root, index)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.count_words(table(spark, sf_dir, "documents"))
    return spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECE_BPE))


def queries() -> dict:
    found = (
        op1_document_fingerprints, op2_near_duplicates, op3_chunked_media, op4_toxicity, op5_token_counts,
        op6_importance_resampling, op7_best_fit_packing, op8_chat_windows, op9_piece_round_trip, op10_token_files,
        op11_license_scan, op12_spelling_variants, op13_token_alignment,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op11_license_scan": licenses.twin_sql(), "op12_spelling_variants": spelling.twin_sql()}
