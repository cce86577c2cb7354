"""Golden questions and profiles from files."""

import json

import pytest

from veridoc.plans.policies import read_profile_file
from veridoc.sources.corpus import golden_problems, read_golden_files

GOLDEN = [
    {"id": "a", "pregunta": "¿Qué?", "tipo": "positiva", "documento_esperado": "x.md", "prohibido": ["z"]},
    {"id": "b", "pregunta": "¿Qué?", "tipo": "positiva"},
    {"id": "c", "pregunta": "¿Qué?", "tipo": "negativa", "debe_declinar": True},
    {"id": "d", "pregunta": " ", "tipo": "negativa"},
    {"id": "e", "pregunta": "¿Qué?", "tipo": "otra", "documento_esperado": "y.md"},
    {"id": "a", "pregunta": "¿Qué?", "tipo": "enmascarada", "documento_esperado": "x--002.md"},
    {"pregunta": "¿Qué?", "tipo": "enmascarada", "documento_esperado": ""},
]


def test_golden_questions_are_held_against_a_corpus(spark, tmp_path):
    (tmp_path / "golden.json").write_text("\n".join(map(json.dumps, GOLDEN)))
    golden = read_golden_files(spark, str(tmp_path))
    assert golden.count() == len(GOLDEN) and golden.filter("id = 'c' and must_decline and size(forbidden) = 0").count() == 1
    corpus = spark.createDataFrame([("x--001.md", 1), ("x--002.md", 1), ("z.md", 1)], "document_id string, id int")
    got = sorted((r["id"] or "", r["problem"]) for r in golden_problems(golden, corpus).collect())
    assert got == [("", "no_id"), ("a", "repeated_id"), ("b", "expects_no_document"), ("d", "must_decline"), ("d", "no_question"), ("e", "not_in_corpus"), ("e", "unknown_kind")]
    assert golden_problems(golden.limit(0), corpus).count() == 0


def test_profiles_are_read_from_a_file(spark, tmp_path):
    path = tmp_path / "profiles.json"
    path.write_text(json.dumps({"uno": {"top_k": 3, "chunking": {"max_chars": 900, "overlap_chars": 10, "min_chars_to_split": 1000}}, "dos": {}}))
    found = read_profile_file(spark, str(path))
    assert list(found) == ["uno", "dos"] and found["uno"].top_k == 3 and found["uno"].chunking.max_chars == 900
    path.write_text(json.dumps([{"slug": "a"}, {"slug": "a"}]))
    with pytest.raises(ValueError):
        read_profile_file(spark, str(path))
