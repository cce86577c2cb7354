"""Properties and inline fixtures of operators that the given tables don't exercise."""

import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from veridoc.functions import text as t
from veridoc.operators import chunking, cleaning, index, predicates, tables
from veridoc.plans.policies import Chunking, read_profiles
from veridoc.sources import corpus
from veridoc.streaming import events as ev

SMALL = Chunking(600, 80, 800)


def test_short_text_is_one_chunk():
    assert chunking.chunk_text(" hola ", SMALL) == ["hola"]
    assert chunking.chunk_text("  ", SMALL) == [] and chunking.chunk_text(None, SMALL) == []


def test_chunks_split_at_headings_and_keep_every_sentence():
    text = "\n\n".join(f"# Sección {s}\n\n" + " ".join(f"Frase número {i} de la sección {s}." for i in range(40)) for s in range(4))
    parts = chunking.chunk_text(text, SMALL)
    assert len(parts) > 4 and all(len(p) <= 602 for p in parts)
    for s in range(4):
        for i in range(40):
            assert any(f"Frase número {i} de la sección {s}." in p for p in parts)


def test_table_repeats_its_head_and_banner():
    rows = "\n".join(f"| Equipo número {i} | • | - | • |" for i in range(40))
    plain = chunking.chunk_text(f"| Equipo | A | B | C |\n|---|---|---|---|\n{rows}", SMALL)
    assert len(plain) > 1 and all("| Equipo | A | B | C |\n|---|" in p for p in plain)
    banner = chunking.chunk_text(f"| X | X | X | X |\n|---|---|---|---|\n| Equipo | A | B | C |\n{rows}", SMALL)
    assert all("| Equipo | A | B | C |" in p for p in banner)


@pytest.mark.parametrize("bad", [(0, 0), (10, -1), (10, 10)])
def test_invalid_policy(bad):
    with pytest.raises(ValueError):
        Chunking(*bad, 10)


def test_profiles_are_strict():
    assert list(read_profiles([{"slug": "a"}, {"slug": "b", "chunking": {"max_chars": 100, "overlap_chars": 1}}])) == ["a", "b"]
    for wrong in ([{"slug": "a", "what": 1}], [{"slug": "a"}, {"slug": "a"}], [{"slug": "a", "redaction": ["x"]}]):
        with pytest.raises(ValueError):
            read_profiles(wrong)


def test_masking(spark):
    rows = [("CURP GOOL850315HDFRRS09.",), ("RFC GOOL850315AB1",), ("tel 55 1234 5678 y +52 (55)12345678",), ("licencia 12345678",), ("año 2024, 12 de 15",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(t.mask_identifiers(F.col("x"))).collect()]
    assert got[0] == "CURP **************RS09." and got[1] == "RFC *********5AB1"[:4] + "*" * 9 + "5AB1"[-4:]
    assert got[2].count("5678") == 2 and "1234 5678" not in got[2]
    assert got[3] == "licencia ****5678" and got[4] == rows[4][0] and got[5] is None


def test_stream_masking_equals_whole_masking():
    names = ("curp", "rfc", "telefono", "cedula")
    text = "El CURP GOOL850315HDFRRS09 y tel 55 1234 5678, fin. Otro +52 (55)12345678 aquí mismo queda"
    for size in (1, 2, 3, 5, 8, 13):
        held, out = "", ""
        for i in range(0, len(text), size):
            held += text[i : i + size]
            cut = ev.safe_prefix(held)
            out += ev.mask_text(held[:cut], names)
            held = held[cut:]
        assert out + ev.mask_text(held, names) == ev.mask_text(text, names)


def test_token_bucket_rejects_the_21st():
    passed, _, _ = ev.spend(ev.BUCKET, None, [i * 0.01 for i in range(21)])
    assert passed == [True] * 20 + [False]
    assert ev.spend(0.0, 0.0, [3.0])[0] == [True]


def test_clean_pages(spark):
    pages = [("d", p, f"Título legal\nDato {p}\ncontenido {p}\nlínea {p}\nmás {p}\nfin {p}\n{p + 1}") for p in range(6)]
    pages += [("z", p, f"A{p}\nB{p}\nC{p}\n0") for p in range(6)] + [("e", 0, "x\nPágina 3 de 12\n125\n87")]
    df = spark.createDataFrame(pages, "doc_id string, page_no int, text string")
    got = dict(cleaning.clean_pages(df).collect())
    assert got["d"].count("Título legal") == 1 and not re.search(r"^\d$", got["d"], re.M)
    assert got["z"].count("\n0") == 6 and got["e"] == "x\n125\n87"


def test_classify_precedence(spark):
    from veridoc.plans.policies import DocumentClass, Documents

    policy = Documents((DocumentClass("a", types=("cv",)), DocumentClass("b", paths=("x/*",)), DocumentClass("c", markers=("secreto",))), exposes=("b",))
    rows = spark.createDataFrame([("x/y/z", "cv", "SECRETO"), ("x/y/z", "cv", ""), ("q", "cv", ""), ("q", "", "")], "p string, t string, x string")
    got = [tuple(r) for r in rows.select(predicates.classify(F.col("p"), F.col("t"), F.col("x"), policy).alias("c")).select("c", predicates.exposed(F.col("c"), policy)).collect()]
    assert got == [("c", False), ("b", True), ("a", False), ("interna", False)]
    assert spark.range(1).select(predicates.exposed(F.lit(None).cast("string"), policy)).first()[0] is False


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text(" título ")
    (tmp_path / "sub" / "a.md.metadata.json").write_text('{"metadataAttributes": {"tipo": "cv"}}')
    (tmp_path / "b.txt").write_text("otro")
    (tmp_path / "b.txt.metadata.json").write_text("{broken")
    got = {r.document_id: (r.text, r.metadata) for r in corpus.read_prepared_corpus(spark, str(tmp_path)).collect()}
    assert got == {"a.md": ("título", {"tipo": "cv"}), "b.txt": ("otro", {})}
    listed = {r.rel_path for r in corpus.read_originals(spark, str(tmp_path)).select("rel_path").collect()}
    assert listed == {"sub/a.md", "b.txt"}


def test_parsers(spark):
    xml = '<CedulaElectronica><Cedula numeroCedula="123" fechaExpedicion="05/03/2020 10:00" entidadFederativa="JAL"/><Profesionista nombre="ANA" primerApellido="PEREZ" segundoApellido="RUIZ" curp="X"/><Institucion nombreInstitucion="UNIVERSIDAD X"/><Carrera nombreCarrera="INGENIERIA CIVIL"/></CedulaElectronica>'
    row = corpus.parse_license_xml(spark.createDataFrame([(xml,), ("<otro/>",)], "content string")).collect()
    assert len(row) == 1 and row[0].document_id == "cedula-profesional-ingenieria-civil-2020.md" and row[0].fecha == "5 de marzo de 2020" and row[0].titular == "Ana Perez Ruiz"
    act = '{"data":{"user":{"year2023":{"totalCommitContributions":5},"year2024":{"totalCommitContributions":7,"totalPullRequestContributions":2}}}}'
    years = corpus.parse_activity_json(spark.createDataFrame([("u", act), ("v", "[1]")], "k string, content string"), "k")
    assert [tuple(r) for r in corpus.activity_totals(years, "k").collect()] == [("u", 12, 2023, 2024)]
    body = 'event: a\ndata: {"x":1}\n\n: hola\n\ndata: nada{\n\ndata: [DONE]\n\n'
    sse = corpus.parse_sse(spark.createDataFrame([(1, body)], "id int, body string"), "id").orderBy("frame_no").collect()
    assert [(r.event, r.data) for r in sse] == [("a", '{"x":1}'), ("", "[DONE]")]
    with pytest.raises(ValueError):
        corpus.read_golden(spark, [{"id": "1", "pregunta": "a", "tipo": "positiva"}])


def test_tables(spark):
    cells = [("t", 0, 0, ""), ("t", 0, 1, "COOL"), ("t", 0, 2, "STYLE"), ("t", 1, 0, "Techo"), ("t", 1, 1, "•"), ("t", 1, 2, ""), ("t", 2, 0, "Frenos"), ("t", 2, 1, "ABS"), ("t", 2, 2, ""), ("t", 3, 0, "Seguridad"), ("t", 3, 1, ""), ("t", 3, 2, "")]
    text = tables.tables_to_text(spark.createDataFrame(cells, "table_id string, row_idx int, col_idx int, text string")).first().text
    assert text == "Techo: solo en COOL\nFrenos: ABS (COOL)\n## Seguridad"
    ink = spark.createDataFrame([("a", x) for x in (0.0, 0.0001, 0.005, 0.006)] + [("b", x) for x in (0.004, 0.005)], "table_id string, ink double")
    got = dict(tables.mark_threshold(ink).collect())
    assert got["a"] == pytest.approx(0.00255) and got["b"] is None
    words = spark.createDataFrame([("t", 0, "a", 0.0, 0.1), ("t", 0, "b", 0.102, 0.2), ("t", 0, "c", 0.5, 0.6)], "table_id string, row_idx int, text string, left double, right double")
    assert sorted(r.text for r in tables.group_cell_words(words).collect()) == ["a b", "c"]
    md = "| Equipo | COOL | STYLE |\n|---|---|---|\n| Escape doble cromado | • | - |"
    lines = spark.createDataFrame([("hilux", i, x) for i, x in enumerate(md.split("\n"))], "doc_id string, line_no int, line string")
    q = tables.make_questions(tables.table_header_fill(lines), 10).collect()
    assert [(r.version, r.feature, r.question) for r in q] == [("COOL", "Escape doble cromado", "hilux COOL Escape doble cromado")]
    hits = spark.createDataFrame([(1, "d", md, "Escape doble cromado", "cool"), (2, "d", "Escape doble cromado • -", "Escape doble cromado", "cool")], "question_id int, document_id string, text string, feature string, version string")
    assert dict((r.question_id, r.alignable) for r in tables.alignable(hits).collect()) == {1: True, 2: False}


def test_index(spark):
    rows = [("1t24-reporte",), ("banco-mzo23-balance",), ("cnbv-n-2020",), ("otra",)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "s string").select(index.doc_family(F.col("s")), index.doc_period(F.col("s"))).collect()]
    assert got == [("reporte-trimestral", "1T24"), ("balance-mensual", "Marzo 2023"), ("reporte-anual", "2020"), ("documento", None)]
    found = index.extract_json_object.func(pd.Series(['x {"a": {"b": 1}} y', "```json\n{}\n```", "{", None]))
    assert found.tolist()[:2] == ['{"a": {"b": 1}}', "{}"] and found[2] is None and found[3] is None
    cards = spark.createDataFrame([("a", "x" * 500, "{}"), ("b--1", "x" * 500, "{}"), ("c", "x", "{}"), ("d", "x" * 500, None)], "name string, text string, metadata_json string")
    assert [r.problem for r in index.index_check(cards).orderBy("name").collect()] == [None, "looks_like_a_chunk", "size", "no_metadata"]


def test_sql_functions(spark):
    from veridoc.functions.registration import register_functions

    register_functions(spark)
    row = spark.sql("select fold_text('Título ÑANDÚ') a, slug_text(' Ficha Técnica: X ') b, condense_text('¿Cuál es el título de ingeniería?') c, is_denial_text('No consta.') d, document_base('hilux--003.md') e, fold_any_text('Ά') f, mask_text_ids('licencia 12345678') g").first()
    assert tuple(row) == ("titulo nandu", "ficha-tecnica-x", "título ingeniería", True, "hilux", "α", "licencia ****5678")
    got = spark.sql("select t.* from values ('uno. dos. tres.') v(x), lateral chunk_text(v.x, 6, 0, 5) t").collect()
    assert [r.chunk_text for r in got] == ["uno.", "dos.", "tres."]


def test_incremental_prep_equals_batch(spark):
    from veridoc.plans import corpus_plans, stream_plans

    sf = "/root/testdata/sf0.001"
    key = lambda r: (r.doc_id, r.chunk_index, r.chunk_text)
    assert sorted(map(key, stream_plans.incremental_prep(spark, sf).collect())) == sorted(map(key, corpus_plans.chunk_documents(spark, sf).collect()))


def test_streams_equal_batches(spark):
    from veridoc.plans import stream_plans

    sf = "/root/testdata/sf0.001"
    rows = stream_plans.redact_stream(spark, sf).collect()
    assert len(rows) == 200 and all(r.same for r in rows)


def test_hooks(spark):
    from veridoc.operators import hooks

    def engine(part):
        if (part["page_no"] == 2).any():
            raise RuntimeError("roto")
        return part[["doc_key", "page_no"]].assign(text="x", confidence=99.0)

    pages = spark.createDataFrame([("d", 1, b"a"), ("d", 2, b"b")], "doc_key string, page_no int, image binary").coalesce(1)
    got = [tuple(r) for r in hooks.transcribe(pages, engine, 1).select("page_no", "text", "error").orderBy("page_no").collect()]
    assert got == [(1, "x", None), (2, None, "roto")]
    cards = hooks.summarize(spark.createDataFrame([("p",)], "prompt string"), lambda p: "respuesta {\"a\": 1}" + p * 0, "a int")
    assert cards.first().card.a == 1


def test_vector_score_by_scan_and_by_slices_equals_brute_force(spark, monkeypatch):
    import numpy as np
    from veridoc.operators import retrieval

    rng = np.random.default_rng(4)
    x = rng.integers(-3, 4, (300, 6)).astype(float)
    x[7] = x[200]
    rows = [(i, v.tolist() if i != 9 else None, ["a", "b", None][i % 3]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, topic string")
    asked = vectors.filter("vec_id % 4 = 0").withColumnRenamed("vec_id", "query_id")
    x[9] = 0
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for topic in (None, "topic"):
        near = lambda q, v: topic is None or (rows[q][2] is not None and rows[q][2] == rows[v][2])  # noqa: B023, E731
        want = {q: sorted((round(float(unit[q] @ unit[v]), 9) for v in range(300) if near(q, v)), reverse=True)[:5] for q in range(0, 300, 4)}
        for chunk in (8192, 20):
            monkeypatch.setattr(retrieval, "QUERY_CHUNK", chunk)
            monkeypatch.setattr(retrieval, "SLICE_ROWS", 64)
            monkeypatch.setattr(retrieval, "QUERY_BLOCK", 16)
            got = {}
            for r in retrieval.vector_score(vectors, asked, 5, topic=topic).orderBy("query_id", "rank").collect():
                assert near(r.query_id, r.vec_id) and abs(r.score - unit[r.query_id] @ unit[r.vec_id]) < 1e-9
                got.setdefault(r.query_id, []).append(round(r.score, 9))
            assert got.keys() == {q for q, s in want.items() if s} and all(got[q] == pytest.approx(want[q]) for q in got)
            assert retrieval.vector_score(vectors.limit(0), asked, 5).count() == 0


def test_prompt_parts(spark):
    from veridoc.plans import policies, prompts

    rows = spark.createDataFrame([(1, "[a.md]\nx", ["se breve"]), (2, None, None)], "question_id long, context string, turns array<string>")
    masks = policies.Profile(slug="x", redaction=tuple(policies.IDENTIFIERS)[:1])
    got = {r.question_id: r.prompt for r in prompts.build_prompt(rows, masks, "leyes", "en verso", ("Regla propia.",), system_col="turns").collect()}
    assert got[1].startswith(prompts.PREFERENCES + "\nen verso\nse breve\n\nRespondes") and got[1].endswith("FRAGMENTOS:\n\n[a.md]\nx\n")
    assert f"5. {prompts.MASK_RULE}" in got[1] and "9. Regla propia." in got[1] and got[2].endswith(prompts.NO_EVIDENCE) and "se breve" not in got[2]
    plain = prompts.build_prompt(rows, masks, "leyes", reveal=True).first().prompt
    assert f"5. {prompts.REVEAL_RULE}" in plain and plain.startswith("Respondes")


def test_tables_without_header_and_with_marks(spark):
    def text(rows, marked=()):
        cells = [("t", i, j, x, (i, j) in marked) for i, row in enumerate(rows) for j, x in enumerate(row)]
        return tables.tables_to_text(spark.createDataFrame(cells, "table_id string, row_idx int, col_idx int, text string, marked boolean")).first().text

    assert text([["Año", "Monto"], ["2020", "5"], ["2021", "6"]]) == "Año: 2020 | Monto: 5\nAño: 2021 | Monto: 6"
    assert text([["Año", "Monto"], ["2020", "5"]]) == "2020 | 5"
    assert text([["x" * 31, "y" * 40], ["2020", "5"], ["2021", None]], {(2, 1)}) == "2020 | 5\n2021 | [marcado]"
    matrix = [["", "A", "B"], ["Techo", "", ""], ["Radio", None, None], ["Frenos", "ABS", ""], ["Otros", "", ""], ["", "", ""]]
    assert text(matrix, {(1, 0 + 2), (2, 1), (2, 2)}) == "Techo: solo en B\nRadio: en todas las versiones\nFrenos: ABS (A)\n## Otros"
    lines = spark.createDataFrame([(1, 2, "pie", False), (1, 0, "Título", None), (1, 1, "celda", True), (2, 0, " ", False)], "page_id int, line_no int, text string, in_table boolean")
    held = spark.createDataFrame([(1, 0, "a: b"), (1, 1, "")], "page_id int, table_no int, text string")
    assert {r.page_id: r.text for r in tables.page_text(lines, held).collect()} == {1: "Título\npie\na: b", 2: ""}
