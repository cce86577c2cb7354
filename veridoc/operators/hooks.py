"""Places for a user's own engines: transcription of pages, summaries of samples, and ordered extractors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridoc.operators.index import extract_json_object


def transcribe(pages: DataFrame, engine: Callable[[pd.DataFrame], pd.DataFrame], batch_rows: int = 8) -> DataFrame:
    """(doc_key, page_no, text, confidence, error): the engine's output for pages (doc_key, page_no, image).

    The engine gets up to ``batch_rows`` pages at a time and returns doc_key, page_no, text and confidence; if it
    raises, its pages become rows with the error, and the others go on. Keys reach the engine as strings, for pandas
    would turn whole numbers beside a null into floats; they come back as they were."""
    kind = dict(pages.dtypes)["doc_key"]
    columns = ["doc_key", "page_no", "text", "confidence", "error"]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[list] = [[] for _ in columns]
            for at in range(0, len(part), batch_rows):
                some = part.iloc[at : at + batch_rows]
                try:
                    out = engine(some)
                    rows = [out[c].tolist() for c in columns[:-1]] + [[None] * len(out)]
                except Exception as e:  # an engine's failure is a result here
                    n = len(some)
                    rows = [some["doc_key"].tolist(), some["page_no"].tolist(), [None] * n, [float("nan")] * n, [str(e)] * n]
                for held, more in zip(found, rows, strict=True):
                    held += more
            # one frame for all of them: a frame has a cost of its own, however few its rows
            yield pd.DataFrame(dict(zip(columns, found, strict=True)))

    keyed = pages.withColumn("doc_key", F.col("doc_key").cast("string"))
    out = keyed.mapInPandas(run, "doc_key string, page_no int, text string, confidence double, error string")
    return out.withColumn("doc_key", F.col("doc_key").cast(kind))


def summarize(samples: DataFrame, model: Callable[[pd.Series], pd.Series], schema: str, prompt: str = "prompt") -> DataFrame:
    """samples with card: the JSON object in the model's answer to each prompt, or null where it has none."""
    answer = F.pandas_udf(model, "string")
    return samples.withColumn("card", F.from_json(extract_json_object(answer(F.col(prompt))), schema))


def extracted(extension: Column, extractors: dict[str, Callable[[], Column]]) -> Column:
    """The result of the first extractor, in order, that is declared for the extension and gives one."""
    return F.coalesce(*[F.when(extension == e, make()) for e, make in extractors.items()])
