"""A corpus written as files and read back, with tasks and jobs that fail."""

import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException

from veridoc.sources import corpus
from veridoc.sources.corpus_files import CorpusFilesWriter, committed
from veridoc.sources.shared import shared_dir

CHUNKS = "document_id string, text string, metadata map<string,string>, extra int"
ROWS = [("a.md", "uno\n", {"tipo": "ficha", "perfil": "otro"}, 1), ("b--001.md", "dos é 😀", {}, 2), ("b--002.md", None, None, 3), ("c.txt", "  ", {"k": "\"v\"\n"}, 4)]


def read(spark, root):
    return sorted((r["document_id"], r["text"], json.dumps(r["metadata"], sort_keys=True)) for r in corpus.read_prepared_corpus(spark, root).collect())


def wanted(rows, profile="p"):
    return sorted((i, (t or "").strip(), json.dumps({**(m or {}), "perfil": profile}, sort_keys=True)) for i, t, m, _ in rows)


def test_corpus_is_read_back_as_it_was_written(spark):
    root = shared_dir(spark, "corpus")
    table = spark.createDataFrame(ROWS, CHUNKS).repartition(3)
    corpus.write_corpus(table, root, "p", False, "/nowhere")
    assert read(spark, root) == wanted(ROWS)
    more = spark.createDataFrame([("d.md", "cuatro", None, 1)], CHUNKS)
    corpus.write_corpus(more, root, "p", False, "/nowhere", overwrite=False)
    assert read(spark, root) == wanted([*ROWS, ("d.md", "cuatro", None, 1)])
    corpus.write_corpus(more, root, "p", False, "/nowhere")  # replaces all before it
    assert read(spark, root) == wanted([("d.md", "cuatro", None, 1)])
    corpus.write_corpus(more.limit(0), root, "p", False, "/nowhere")
    assert read(spark, root) == []
    assert {r["document_id"] for r in corpus.read_text_docs(spark, root).collect()} == set()


def test_destination_is_checked_before_anything_is_written(spark):
    root = shared_dir(spark, "corpus")
    table = spark.createDataFrame(ROWS, CHUNKS)
    with pytest.raises(ValueError):
        corpus.write_corpus(table, root, "privado", True, root + "-private")
    assert committed(spark, root) is None
    corpus.write_corpus(table, root + "/x", "privado", True, root)
    assert len(read(spark, root + "/x")) == 4


def test_repeated_ids_and_bad_names_commit_nothing(spark):
    root = shared_dir(spark, "corpus")
    with pytest.raises(ValueError, match="repeat"):
        corpus.write_corpus(spark.createDataFrame([ROWS[0], ROWS[0]], CHUNKS), root, "p", False, "")
    for bad in ("../x.md", None, "", ".hidden", "_x", "a.metadata.json"):
        with pytest.raises(PySparkException):
            corpus.write_corpus(spark.createDataFrame([*ROWS, (bad, "t", None, 1)], CHUNKS).repartition(4), root, "p", False, "")
    assert committed(spark, root) is None
    corpus.write_corpus(spark.createDataFrame(ROWS, CHUNKS), root, "p", False, "")  # the same place works after that
    assert read(spark, root) == wanted(ROWS)


def batches(rows, fail_at=None):
    for i, (name, text, held, _) in enumerate(rows):
        if i == fail_at:
            raise OSError("executor lost")
        yield pa.RecordBatch.from_pydict({"document_id": [name], "text": [text], "metadata": pa.array([list((held or {}).items())], pa.map_(pa.string(), pa.string()))})


def test_a_task_that_fails_once_leaves_nothing_that_is_read(spark):
    root = shared_dir(spark, "corpus")
    writer = CorpusFilesWriter(root, True)
    with pytest.raises(OSError):
        writer.write(batches(ROWS, 2))
    first = writer.write(batches(ROWS[:2]))
    again, twin = writer.write(batches(ROWS[2:])), writer.write(batches(ROWS[2:]))  # the second is a speculative copy
    assert committed(spark, root) is None
    writer.commit([first, None, again])
    got = read(spark, root)
    assert [r[:2] for r in got] == sorted((i, (t or "").strip()) for i, t, _, _ in ROWS) and twin.folder not in str(committed(spark, root))
    late = CorpusFilesWriter(root, False)
    late.abort([late.write(batches(ROWS)), None])
    assert read(spark, root) == got
