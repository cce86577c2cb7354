"""A prepared corpus as files, a text and a sidecar for each chunk, written by a Spark data source.

Each task writes to a folder of its own attempt; only when all tasks have ended is a commit created that names the
folders of those that count. Readers take the folders that commits name, so attempts that failed or were repeated
are never read, and a corpus is seen whole or not at all.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from veridoc.sources.shared import Files

FORMAT = "prepared_corpus"
COMMITS = "_commits"
SIDECAR = ".metadata.json"
#: Documents of a folder at most; and code points of texts that a reading task hands on at once.
FOLDER_DOCUMENTS, BATCH_CHARS = 4096, 1 << 22


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root}")


def check_name(document_id: str | None) -> str:
    """The id as a file's name; raises ValueError where it cannot be one."""
    if not document_id or "/" in document_id or document_id.startswith((".", "_")) or document_id.endswith(SIDECAR):
        raise ValueError(f"{document_id!r} cannot name a file of a corpus")
    return document_id


@dataclass
class Attempt(WriterCommitMessage):
    folder: str
    n: int


class CorpusFilesWriter(DataSourceArrowWriter):
    """Writes (document_id, text, metadata) below root; with overwrite the commit replaces all before it."""

    def __init__(self, root: str, overwrite: bool):
        self.root, self.overwrite, self.job = root.rstrip("/"), overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        store, root = _store(self.root)
        folder, n = f"data/{self.job}/{uuid.uuid4().hex[:12]}", 0
        for batch in iterator:
            for row in batch.to_pylist():
                name = check_name(row["document_id"])
                if n % FOLDER_DOCUMENTS == 0:
                    part = f"{root}/{folder}/{n // FOLDER_DOCUMENTS:06d}"
                    store.create_dir(part, recursive=True)
                sidecar = json.dumps({"metadataAttributes": dict(row["metadata"] or [])}, ensure_ascii=False)
                for path, text in ((name, row["text"] or ""), (name + SIDECAR, sidecar)):
                    with store.open_output_stream(f"{part}/{path}") as f:
                        f.write(text.encode())
                n += 1
        return Attempt(folder, n)

    def commit(self, messages: list[Attempt | None]) -> None:
        store, root = _store(self.root)
        done = [m for m in messages if m is not None and m.n]
        text = json.dumps({"folders": [f"{m.folder}/{k:06d}" for m in done for k in range(-(-m.n // FOLDER_DOCUMENTS))], "n": sum(m.n for m in done), "replaces": self.overwrite})
        name = f"{time.time_ns():020d}-{self.job}.json"
        store.create_dir(f"{root}/{COMMITS}", recursive=True)
        with store.open_output_stream(f"{root}/{COMMITS}/{name}.tmp") as f:
            f.write(text.encode())
        store.move(f"{root}/{COMMITS}/{name}.tmp", f"{root}/{COMMITS}/{name}")

    def abort(self, messages: list[Attempt | None]) -> None:
        store, root = _store(self.root)
        for m in messages:
            if m is not None and m.n:
                store.delete_dir(f"{root}/{m.folder}")


class CorpusFiles(DataSource):
    """Format of write_corpus; option ``root``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CorpusFilesWriter:
        return CorpusFilesWriter(self.options["root"], overwrite)


def write_files(rows: DataFrame, root: str, overwrite: bool = True) -> None:
    """Writes (document_id, text, metadata map) as files and commits them. Null texts are empty, null metadata an
    empty sidecar. Raises where ids repeat or cannot be names; then nothing is committed."""
    spark = rows.sparkSession
    rows = rows.select("document_id", "text", "metadata")
    twice = rows.groupBy("document_id").agg(F.count("*").alias("n")).filter("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"ids repeat: {[r['document_id'] for r in twice]}")
    spark.dataSource.register(CorpusFiles)
    rows.write.format(FORMAT).mode("overwrite" if overwrite else "append").option("root", root).save()


def committed(spark: SparkSession, root: str) -> list[str] | None:
    """Folders of a corpus that its commits name; None where there are no commits, as below a folder of files that
    others wrote. There is a folder for each task, and FOLDER_DOCUMENTS of it, of each write since the last that
    replaced all."""
    files = Files(spark, root)
    names = [n for n in files.names(COMMITS) if n.endswith(".json")]
    if not names:
        return None
    folders: list[str] = []
    for n in names:
        made = json.loads(files.read(f"{COMMITS}/{n}"))
        folders = ([] if made["replaces"] else folders) + [f"{root.rstrip('/')}/{f}" for f in made["folders"]]
    return folders


def read_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """(document_id, path, text, sidecar) of the documents in folders that commits name. Tasks list the folders, a
    few to each, so that the driver never holds the names of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["document_id", "path", "text", "sidecar"]
        for folder in (f for b in batches for f in b.column("folder").to_pylist()):
            store, root = _store(folder)
            rows, size = [], 0
            found = store.get_file_info(_selector(root))
            for name in sorted(f.base_name.removesuffix(SIDECAR) for f in found if f.base_name.endswith(SIDECAR)):
                text, sidecar = (_content(store, f"{root}/{x}") for x in (name, name + SIDECAR))
                rows.append((name, f"{folder}/{name}", text, sidecar))
                size += len(text) + len(sidecar)
                if size > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names)

    parts = spark.sparkContext.parallelize([(f,) for f in folders], len(folders))
    return spark.createDataFrame(parts, "folder string").mapInArrow(run, "document_id string, path string, text string, sidecar string")


def _selector(root: str):
    from pyarrow import fs

    return fs.FileSelector(root)


def _content(store, path: str) -> str:
    with store.open_input_stream(path) as f:
        return f.read().decode()
