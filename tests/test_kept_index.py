"""The kept token index against scoring over a whole rebuild."""

import random

import pytest

from veridoc.operators import retrieval
from veridoc.operators.kept_index import TokenIndex
from veridoc.sources.shared import Files, shared_dir

WORDS = ["turbine", "valve", "boiler", "pression", "énergie", "rotor", "stator", "flange", "gasket", "weld", "copper", "steel", "voltage", "current", "phase", "fuse"]


def texts(rng, n):
    return {f"doc-{i}.md": " ".join(rng.choices(WORDS, weights=range(1, 17), k=rng.randint(1, 8))) for i in range(n)}


def table(spark, docs):
    return spark.createDataFrame(list(docs.items()), "document_id string, text string")


def rows(df):
    return sorted((r["question_id"], r["query_idx"], r["document_id"], round(r["score"], 9)) for r in df.collect())


@pytest.fixture(scope="module")
def asked(spark):
    rng = random.Random(2)
    return retrieval.planned(spark.createDataFrame([(i, " ".join(rng.sample(WORDS, rng.randint(1, 7)))) for i in range(30)] + [(90, "of the"), (91, "unknown words")], "question_id long, question string")).cache()


def same(spark, index, docs, asked):
    want = rows(retrieval.lexical_score(asked, retrieval.indexed(table(spark, docs))))
    assert rows(index.search(asked)) == want
    return want


def test_updates_equal_a_whole_rebuild(spark, asked):
    rng = random.Random(1)
    docs = texts(rng, 300)
    index = TokenIndex(spark, shared_dir(spark, "kept"), buckets=8)
    assert rows(index.search(asked)) == []
    assert index.update(table(spark, docs)) == {"new": 300, "changed": 0, "deleted": 0}
    assert same(spark, index, docs, asked)
    before = index.state()
    assert index.update(table(spark, docs)) == {"new": 0, "changed": 0, "deleted": 0} and index.state() == before
    # of 100 documents one changes; three rounds, with a return to an old text, new and deleted documents
    first = dict(docs)
    docs |= {"doc-7.md": "rotor weld", "doc-8.md": "", "doc-9.md": "copper copper"}
    assert index.update(table(spark, docs)) == {"new": 0, "changed": 3, "deleted": 0}
    segment = index.state()["segments"][-1]
    folder = f"{index.root}/segments/{segment['name']}"
    assert segment["documents"] == 3 and spark.read.parquet(f"{folder}/forward").count() == 3
    assert spark.read.parquet(f"{folder}/postings").count() == spark.read.parquet(f"{folder}/forward").selectExpr("sum(size(tokens)) s").first()["s"]
    same(spark, index, docs, asked)
    docs["doc-7.md"] = first["doc-7.md"]
    del docs["doc-5.md"], docs["doc-6.md"]
    docs["doc-900.md"] = "turbine énergie"
    assert index.update(table(spark, docs)) == {"new": 1, "changed": 1, "deleted": 2}
    want = same(spark, index, docs, asked)
    docs["doc-5.md"] = "fuse"
    assert index.update(table(spark, docs))["new"] == 1
    same(spark, index, docs, asked)
    # frequencies are those of live documents
    tokens = spark.createDataFrame([(w,) for w in ["rotor", "energie", "copper", "nowhere", "900"]], "token string")
    sets = {r["document_id"]: set(r["tokens"]) for r in retrieval.indexed(table(spark, docs)).collect()}
    held = {w: sum(w in s for s in sets.values()) for w in ("rotor", "energie", "copper", "900")}
    assert {r["token"]: r["df"] for r in index.frequencies(tokens).collect()} == held
    index.compact()
    assert len(index.state()["segments"]) == 1 and index.state()["segments"][0]["documents"] == len(docs)
    assert same(spark, index, docs, asked) and want
    assert len(index.vacuum(keep=1)) == 4
    same(spark, index, docs, asked)


def test_many_updates_compact_themselves(spark, asked):
    docs = texts(random.Random(4), 40)
    index = TokenIndex(spark, shared_dir(spark, "kept"), buckets=2)
    index.update(table(spark, docs))
    for i in range(10):
        docs[f"doc-{i}.md"] = "boiler phase"
        index.update(table(spark, docs))
        assert len(index.state()["segments"]) <= 9
    assert index.state()["version"] == 12 and len(index.state()["segments"]) < 9
    same(spark, index, docs, asked)
    index.update(table(spark, {}))
    assert rows(index.search(asked)) == [] and index.documents().count() == 0


def test_failed_and_rival_updates_change_nothing(spark, asked, monkeypatch):
    docs = texts(random.Random(5), 30)
    index = TokenIndex(spark, shared_dir(spark, "kept"), buckets=2)
    index.update(table(spark, docs))
    old = rows(index.search(asked))
    changed = docs | {"doc-1.md": "fuse fuse", "doc-2.md": None}
    monkeypatch.setattr(index, "_commit", lambda state: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        index.update(table(spark, changed))
    monkeypatch.undo()
    assert rows(index.search(asked)) == old
    stale = index.state()
    index.update(table(spark, changed), compact=False)
    same(spark, index, {k: v or "" for k, v in changed.items()}, asked)
    with pytest.raises(FileExistsError):
        index._commit(stale | {"version": stale["version"] + 1})
    assert len(index.vacuum()) == 1


def test_repeated_and_missing_ids_and_clashing_columns(spark, asked):
    index = TokenIndex(spark, shared_dir(spark, "kept"))
    docs = spark.createDataFrame([("a.md", "rotor", "h", 1), ("a.md", "rotor", "h", 2), ("b.md", "stator", "h", 3), ("b.md", "fuse", "h", 3), (None, "weld", "h", 1)], "document_id string, text string, hash string, version int")
    assert index.update(docs) == {"new": 2, "changed": 0, "deleted": 0}
    assert index.update(docs) == {"new": 0, "changed": 0, "deleted": 0}
    assert {r["document_id"]: r["tokens"] for r in index.documents().collect()}.keys() == {"a.md", "b.md"}
    given = docs.limit(1).select("document_id", "text").selectExpr("*", "'own' as digest")
    assert index.update(given, hash_col="digest")["changed"] == 1
    assert index.update(given.selectExpr("document_id", "'other text' as text", "digest"), hash_col="digest") == {"new": 0, "changed": 0, "deleted": 0}


def test_files_are_created_once(spark):
    files = Files(spark, shared_dir(spark, "files"))
    assert files.names("x") == []
    files.create("x/a.json", "é")
    with pytest.raises(FileExistsError):
        files.create("x/a.json", "b")
    assert files.names("x") == ["a.json"] and files.read("x/a.json") == "é"
