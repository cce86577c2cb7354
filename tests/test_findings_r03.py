"""What the findings of round 3 named, against libraries and plain ways."""

import pytest

pytest.importorskip("veridoc.llm")

from veridoc.llm import alignment, piece_bpe, queries  # noqa: E402

#: A newline behind a space in texts that are cut at space marks: double or leading spaces, or a mark of their own.
MARKED_NEWLINES = ["a  b \nc", "\na  b", " a \n b", "a▁\nb", "  \n  \n", " x \n", "\n", " \n", "a \nb"]


def test_newlines_behind_space_marks_equal_the_library(spark):
    path = queries.tokenizer_path(queries.PIECE_BPE)
    bpe, memo = piece_bpe.model(path)
    got = [[int.from_bytes(x[k : k + 4], "little") for k in range(0, len(x), 4)] for x in memo(MARKED_NEWLINES)]
    assert got == bpe.library.encode(MARKED_NEWLINES)
    docs = spark.createDataFrame(list(enumerate(MARKED_NEWLINES)), "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.link_statistics(docs, queries.tokenizer_path(queries.BYTE_BPE), path).collect()}
    for k, text in enumerate(MARKED_NEWLINES):  # only a mark in the text itself is read back as a space
        assert rows[k].n_b == (0 if "▁" in text else len(bpe.library.encode(text)))


def test_doc_type_makes_one_slug(spark):
    from pyspark.sql import functions as F

    from veridoc.functions import text as t

    plan = lambda c: spark.range(1).select(F.lit("x").alias("s")).select(c)._jdf.queryExecution().analyzed().toString()
    assert plan(t.doc_type(F.col("s"))).count("lower(") == plan(t.slug(F.col("s"))).count("lower(")
    rows = spark.createDataFrame([("CV x",), ("Título Pro",), ("la FICHA y el folleto",), ("a constancia",), ("",), (None,)], "s string")
    assert [r[0] for r in rows.select(t.doc_type(F.col("s"))).collect()] == ["cv", "titulo", "ficha_tecnica", "certificado", "documento", "documento"]


def test_few_queries_are_scored_in_one_scan(spark, monkeypatch):
    import random

    from veridoc.operators import retrieval

    rng = random.Random(3)
    some = lambda n: rng.sample([f"w{i}" for i in range(60)], n)
    queries = spark.createDataFrame([(q // 2, q % 2, some(rng.randint(0, 12))) for q in range(40)], "question_id long, query_idx int, tokens array<string>")
    index = spark.createDataFrame([(f"d{i}", some(rng.randint(0, 30)) if i % 17 else []) for i in range(300)] + [("none", None)], "document_id string, tokens array<string>")
    monkeypatch.setattr(retrieval, "COUNTED", 500)
    held = lambda df: sorted(tuple(r) for r in df.collect())
    found = retrieval.lexical_score(queries, index)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    monkeypatch.setattr(retrieval, "QUERY_CHUNK", 3)
    assert held(found) == held(retrieval.lexical_score(queries, index)) != []
    assert retrieval.scanned(queries.limit(0), index).count() == 0


def test_the_driver_lists_no_files_of_a_corpus(spark):
    from veridoc.sources import corpus
    from veridoc.sources.shared import shared_dir

    root = shared_dir(spark, "corpus")
    rows = spark.range(5000).selectExpr("concat('d', id, '.md') as document_id", "concat('t', id) as text", "map('k', cast(id as string)) as metadata").coalesce(1)
    corpus.write_corpus(rows, root, "p", False, "")
    back = corpus.read_prepared_corpus(spark, root)
    assert back.inputFiles() == [] and back.rdd.getNumPartitions() == 2  # one task's files are in folders of bounded size
    assert back.filter("text = concat('t', metadata['k']) and document_id = concat('d', metadata['k'], '.md')").count() == back.select("document_id").distinct().count() == 5000


def test_batches_of_a_stream_are_several_files(spark):
    import os

    from pyspark.sql import functions as F
    from veridoc.streaming.runner import arriving

    path = arriving(spark.range(0, 100, 1, 8), "files", 3, F.when(F.col("id") == 7, 2).otherwise(F.col("id") % 2), 4)
    names = [n for n in os.listdir(path.removeprefix("file://")) if n.endswith(".parquet")]
    assert len(names) == 12 and spark.read.parquet(path).count() == 100


def test_an_engine_of_single_pages_gives_one_frame_a_batch(spark):
    import pandas as pd

    from veridoc.operators import hooks

    class Pages:
        dtypes = [("doc_key", "string")]

        def withColumn(self, *_):
            return self

        def mapInPandas(self, run, _):
            self.run = run
            return self

    def engine(part):
        if part["page_no"].iloc[0] == 2:
            raise ValueError("no")
        return part[["doc_key", "page_no"]].assign(text="t", confidence=1.0)

    pages = Pages()
    hooks.transcribe(pages, engine, 1)
    frames = list(pages.run(iter([pd.DataFrame({"doc_key": list("abcd"), "page_no": range(4), "image": b""})])))
    assert len(frames) == 1
    assert [tuple(r) for r in frames[0][["doc_key", "page_no", "text", "error"]].values] == [("a", 0, "t", None), ("b", 1, "t", None), ("c", 2, None, "no"), ("d", 3, "t", None)]


def test_chunks_leave_python_in_batches_of_bounded_size(spark, monkeypatch):
    import pyarrow as pa

    from veridoc.operators import chunking

    policy = chunking.Chunking(600, 80, 800)
    text = "Una frase corta. " * 100
    rows = pa.RecordBatch.from_pydict({"n": list(range(50)), "text": [text, None, "  ", "x", text] * 10})
    parts = list(chunking.chunk_batches([rows], "text", policy, 4000))
    assert len(parts) > 5 and max(p.num_rows for p in parts) < 20
    want = [(n, i, len(c), x) for n, t in zip(rows["n"].to_pylist(), rows["text"].to_pylist(), strict=True) for c in [chunking.chunk_text(t, policy)] for i, x in enumerate(c, 1)]
    got = [(r["n"], r["chunk_index"], r["chunk_total"], r["chunk_text"]) for p in parts for r in p.to_pylist()]
    assert got == want


def test_cells_of_tables_move_once(spark):
    from veridoc.operators import tables

    cells = spark.range(20).selectExpr("id % 3 as table_id", "cast(id / 3 as int) as row_idx", "0 as col_idx", "'x' as text").repartition(3)
    plan = tables.tables_to_text(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1 and "Join" not in plan


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_lines_are_cut_into_parts_where_they_are_read(spark):
    from veridoc.plans.inputs import chunked

    texts = ["", "\n", "a", "a\n", "\na\n\n", "\n".join("abcdefgh"), "\n".join("abcdefgh") + "\n", "\n".join(map(str, range(33))), "x\r\ny z", None]
    docs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "stem string, text string")
    found = chunked(docs)
    assert "Exchange" not in _plan(found)
    lines = lambda t: t.split("\n")
    want = [(f"s{i}", f"s{i}--{k + 1:03d}.md", k + 1, -(-len(lines(t)) // 8), "\n".join(lines(t)[8 * k : 8 * k + 8])) for i, t in enumerate(texts) if t is not None for k in range(-(-len(lines(t)) // 8))]
    assert sorted(map(tuple, found.collect())) == sorted(want)
    twice = chunked(spark.createDataFrame([("s", "a\nb"), ("s", "a\nb"), ("t", "c")], "stem string, text string"))  # rows of one key share a part
    assert sorted((r.stem, r.text) for r in twice.collect()) == [("s", "a\na\nb\nb"), ("t", "c")]


def test_kept_cards_hash_texts_once(spark, tmp_path, monkeypatch):
    from veridoc.operators import kept_cards

    sample = spark.createDataFrame([("a", 1, "a--001.md", "x"), ("b", 1, "b--001.md", "y")], "stem string, chunk_index int, document_id string, text string")
    hashed = kept_cards.sample_hash
    reads = []
    seen = spark.sparkContext.accumulator(0)

    def counted(rows):
        def pass_on(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        reads.append(1)
        return hashed(rows).mapInArrow(pass_on, "stem string, sample_hash string")

    monkeypatch.setattr(kept_cards, "sample_hash", counted)
    kept = kept_cards.KeptCards(spark, f"file://{tmp_path}/cards")
    make = lambda rows: rows.selectExpr("stem", "text as card")
    assert kept.refresh(sample, make) == {"made": 2, "kept": 0, "removed": 0}
    assert kept.refresh(sample, make) == {"made": 0, "kept": 2, "removed": 0}
    assert len(reads) == 2 and seen.value == 4


def test_words_are_folded_together(spark):
    from pyspark.sql import functions as F
    from veridoc.functions import text as t

    rows = spark.createDataFrame([("Été été ÉTUDE de la ﬁnal",), ("",), (None,), ("de",), ("ﾞﾞﾞ ﷺxx",)], "s string")
    got = [r[0] for r in rows.select(t.token_set(F.col("s"))).collect()]
    assert got == [["ete", "etude", "final"], [], None, [], ["", "صلى الله عليه وسلمxx"]]
    plan = rows.select(t.token_set(F.col("s")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("translate(lower(") <= 2


def test_lines_to_cite_are_folded_as_one_text(spark):
    from pyspark.sql import functions as F
    from veridoc.operators import retrieval

    rows = spark.createDataFrame([("Ésta es una LÍNEA  larga\ncorta\r\nOtra línea bastante ﬁna ΟΔΟΣ abcd ΟΔΟΣ ΟΔΟΣ",), (None,)], "s string")
    column = retrieval.citation_lines(F.col("s"))
    assert [r[0] for r in rows.select(column).collect()] == [["esta es una linea larga", "otra linea bastante fina", "οδος abcd οδος οδος"], None]
    chunks = rows.selectExpr("'d--001.md' as document_id", "1L as doc_id", "s as text")
    found = retrieval.citation_locator(chunks, spark.createDataFrame([(1, 0, "x")], "doc_id long, page_no int, text string"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("[a-z]{4}") == 1


def test_pieces_that_stay_in_a_memo_are_not_encoded_again():
    import numpy as np

    from veridoc.llm.pieces import PieceMemo

    told: list[str] = []

    def encode(joint, alone):
        told.extend(joint + alone)
        return np.array([len(p) for p in joint + alone], np.int64), np.array([ord(c) for p in joint + alone for c in p], np.uint32)

    memo = PieceMemo(encode, limit=12)
    for k in range(30):
        texts = [f"a b\nc a b x{k} y{k} z{k}", None, "a b  b ", f"b a{k} a", ""]
        ids, n = memo.ids(texts)
        assert "".join(map(chr, ids)) == "".join(t or "" for t in texts) and n.tolist() == [len(t or "") for t in texts]
        assert memo.counts(texts).tolist() == n.tolist()
    assert memo.count < 30 and memo.held == sum(len(p) if p[:1] == "\n" else 1 + len(p) for p in memo.tail) + sum(map(len, [*memo.whole, *memo.odd]))
    assert [told.count(p) for p in (" b", " a")] == [1, 1]


def test_f23_tokens_cut_as_arrays_are_those_of_token_set(spark):
    """An index cut texts into tokens match by match in Spark, and sorted a row for each of them."""
    from pyspark.sql import functions as F

    from veridoc.functions import text as t
    from veridoc.operators import kept_index, retrieval

    texts = [None, "", "Uno DOS tres_4 uno", "café CAFÉ cafés the “quoted” a bcd", "ΟΔΟΣ.Α ΟΔΟΣ", "İstanbul ﬁnﬁn Kelvin ẞtraẞe", "한국어 中文字 ab", "end", "ing"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").coalesce(1).withColumn("document_id", F.concat(F.lit("Área-x_y--00"), "k", F.lit(".md")))
    want = {r[0]: set(r[1]) for r in rows.select("document_id", t.chunk_tokens(F.coalesce("text", F.lit("")), F.col("document_id"))).collect()}
    got = retrieval.indexed(rows.select("document_id", "text"))
    assert got.columns == ["document_id", "tokens"] and "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    assert len(found) == len(texts) and {r[0]: set(r[1]) for r in found} == want and all(len(r[1]) == len(set(r[1])) for r in found)
    forward = got.withColumn("version", (F.substring("document_id", -4, 1).cast("int") % 2))
    lists = forward.mapInArrow(kept_index._inverted, "token string, documents array<string>, version int").collect()
    pairs = [(r["token"], d, r["version"]) for r in lists for d in r["documents"]]
    assert sorted(pairs) == sorted((w, d, int(d[-4]) % 2) for d, tokens in want.items() for w in tokens)
    assert len(lists) < len(pairs)


def test_f24_responses_share_a_state(spark, monkeypatch):
    """Each response was a call and a state of its own, which took most of the time."""
    from pyspark.sql import functions as F

    from veridoc.streaming import events as ev
    from veridoc.streaming.runner import arriving, run_available, stream_of

    monkeypatch.setattr(ev, "RESPONSE_BUCKETS", 1)
    big = 2**53 + 1
    texts = {None: "tel 55 1234 5678 fin", big: "a@b.mx y 12345678 ", big + 1: "", 3: "nada que ver", 4: "queda abierta 12345678"}
    rows = [(r, i, "output_text.done" if r != 4 and i == len(x) else "output_text.delta", x[i : i + 1] or None, int(i > len(x) // 2)) for r, x in texts.items() for i in range(len(x) + 1)]
    deltas = spark.createDataFrame(rows, "response_id long, sequence_number int, type string, delta string, b int")
    path = arriving(deltas, "f24", 2, F.col("b"))
    out = ev.redact_stream(stream_of(spark, path, deltas.schema), ("email", "telefono", "cedula"))
    assert out.schema.simpleString() == "struct<response_id:bigint,part:int,text:string>"
    parts = sorted(((r.response_id is not None, r.response_id or 0, r.part, r.text) for r in run_available(out, "f24-out").collect()))
    got = {}
    for some, r, part, text in parts:
        got.setdefault(r if some else None, []).append((part, text))
    assert all([p for p, _ in x] == list(range(len(x))) for x in got.values())
    whole = {r: "".join(x for _, x in parts) for r, parts in got.items()}
    assert whole == {r: ev.mask_text(x, ("email", "telefono", "cedula")) for r, x in texts.items() if r != 4} | {4: "queda abierta "}


def test_op2_only_shared_bands_and_their_texts_are_shuffled(spark):
    """All bands and all texts were shuffled to find the few that are shared."""
    import numpy as np
    import pyarrow as pa

    from veridoc.llm import near_dedup

    rng = np.random.default_rng(5)
    hashes = rng.integers(-(2**63), 2**63, 20_000)
    kept = near_dedup._may_hold(near_dedup._filter(spark.createDataFrame([(int(x),) for x in hashes[:2000]], "band long")))
    found = kept(pa.array(hashes))
    assert found[:2000].all() and found[2000:].sum() < 200
    assert not near_dedup._may_hold(near_dedup._filter(spark.createDataFrame([], "band long")))(pa.array(hashes)).any()
    one = " ".join(f"w{i}" for i in range(60))
    texts = [one, one + " more", "quite another text of some words", None, "", one.upper()]
    keys = [near_dedup.digest(x) for x in texts]
    wanted = near_dedup._filter(spark.createDataFrame([(k,) for k in keys[:2]], "key binary"))
    named = spark.createDataFrame([(x,) for x in texts * 2], "text string").coalesce(1).mapInArrow(near_dedup._named_texts(wanted), "key binary, blob binary")
    assert sorted(bytes(r["key"]) for r in named.collect()) == sorted(keys[:2])
    classes = near_dedup.near_duplicate_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: (r["class_id"], r["n_copies"]) for r in classes.collect()} == {0: (0, 3), 1: (0, 3), 5: (0, 3), 2: (2, 1), 3: (3, 2), 4: (3, 2)}


def test_a_worker_drops_what_a_task_of_another_kind_needed():
    import pyarrow as pa

    from veridoc.llm import common, near_dedup, token_counts

    path = queries.tokenizer_path(queries.BYTE_BPE)
    texts = [f"some words {i} and {i * i} more of them" for i in range(20_000)]
    counted = token_counts.count_texts(texts, path)
    assert token_counts.counter.cache_info().currsize and counted == token_counts.count_texts(texts, path)
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts[:300])], ["id", "text"])
    plain = pa.Table.from_batches(near_dedup._signed([batch]))
    assert token_counts.counter.cache_info().currsize
    assert pa.Table.from_batches(common.lean(near_dedup._signed)([batch])) == plain
    assert not token_counts.counter.cache_info().currsize
    assert token_counts.count_texts(texts, path) == counted
    assert list(common.lean(lambda batches: batches, remembers=True)([batch])) == [batch] and token_counts.counter.cache_info().currsize


def test_a_join_without_hot_keys_is_a_plain_one(spark, monkeypatch):
    from veridoc.llm import common

    rows = spark.createDataFrame([(k % 40 if k % 7 else None, k) for k in range(400)], "k long, v long")
    table = spark.createDataFrame([(k, f"t{k}") for k in range(0, 60, 2)], "k long, name string")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    held = lambda df: sorted(tuple(r) for r in df.collect())
    salted = common.salted_join(rows, table, "k")
    monkeypatch.setattr(common, "HOT_SHARE", 10)  # nulls, the most frequent key, are joined with nothing
    plain = common.salted_join(rows, table, "k")
    assert "_salt" in plan(salted) and "_salt" not in plan(plain) and plan(plain).count("Join") == 1
    assert salted.columns == plain.columns == ["k", "v", "name"] and held(salted) == held(plain) and len(held(plain)) == sum(k % 7 > 0 and k % 2 == 0 for k in range(400))


def test_shingles_of_a_block_are_cut_in_parts(monkeypatch):
    import numpy as np

    from veridoc.llm import near_dedup

    texts = ["", "a b c d e f g", None, "one two", "x " * 50, "a b c d e f h"] * 5
    whole, looked = near_dedup.bags(texts), []
    cut = near_dedup.bags
    monkeypatch.setattr(near_dedup, "bags", lambda part: looked.append(len(part)) or cut(part))
    monkeypatch.setattr(near_dedup, "_PASS_CHARS", 60)
    assert all(np.array_equal(a, b) for a, b in zip(near_dedup._bags_in_parts(texts), whole, strict=True))
    assert near_dedup.overlap(texts[:6], texts[6:12]).tolist() == [0, 1, 0, 1, 1, 1]
    assert max(looked) < 12 and near_dedup._bags_in_parts([])[0].size == 0
