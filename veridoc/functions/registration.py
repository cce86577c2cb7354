"""Functions for SQL: scalars by name and a table function that cuts text into chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from veridoc.functions import text as t
from veridoc.operators.chunking import chunk_text
from veridoc.plans.policies import Chunking


def register_functions(spark: SparkSession) -> None:
    """Makes fold_text, slug_text, condense_text, mask_text_ids, is_denial_text and document_base callable in SQL
    as temporary SQL functions (plain expressions that the optimizer sees), fold_any_text as an Arrow function,
    and chunk_text(text, max_chars, overlap, min_to_split) as a table function."""
    sql = {
        "slug_text": ("regexp_replace(regexp_replace(fold_text(x), '[^a-z0-9]+', '-'), '^-+|-+$', '')", "string"),
        "document_base": ("split_part(regexp_replace(x, '[.]md$', ''), '--', 1)", "string"),
    }
    spark.sql(f"create or replace temporary function fold_text(x string) returns string return {t.fold_sql('x')}")
    stop = ", ".join(map(t.sql_literal, t.STOPWORDS))
    marks = " or ".join(f"contains(lower(x), {t.sql_literal(m)})" for m in t.DENIALS)
    # a SQL function can't be called on a lambda's variable, so folding is spelled out there
    content = f"if(length(w) = octet_length(w), w, {t.fold_sql('w')}) not in ({stop})"
    sql["condense_text"] = (f"array_join(filter(regexp_extract_all(lower(x), {t.sql_literal(t.WORD)}, 0), w -> length(w) > 2 and {content}), ' ')", "string")
    sql["is_denial_text"] = (marks, "boolean")
    for name, (body, kind) in sql.items():
        spark.sql(f"create or replace temporary function {name}(x string) returns {kind} return {body}")
    spark.udf.register("fold_any_text", t.fold_any)
    spark.udf.register("mask_text_ids", _mask)
    spark.udtf.register("chunk_text", _ChunkText)


@F.pandas_udf(T.StringType())
def _mask(texts: pd.Series) -> pd.Series:
    from veridoc.streaming.events import mask_text

    return texts.map(lambda x: mask_text(x, t.PERSONAL), na_action="ignore")


class _Chunks:
    def eval(self, text: str, max_chars: int, overlap: int, min_to_split: int):
        parts = chunk_text(text, Chunking(max_chars, overlap, min_to_split))
        for i, part in enumerate(parts, 1):
            yield i, len(parts), part


_ChunkText = udtf(_Chunks, returnType=T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("chunk_total", T.IntegerType()), T.StructField("chunk_text", T.StringType())]))
