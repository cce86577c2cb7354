"""Findings of round 4, each by a test that failed before."""

import os
import random

import duckdb
import pandas as pd
import pytest

from veridoc.llm import toxicity
from veridoc.operators import tables
from veridoc.plans import derived_plans
from veridoc.streaming import ordered

#: Sentences that are empty, blank, or have other white space than spaces at their ends; bars and marks.
ODD = ["", "a. ", ". . ", " ", " x . \ty\t. z", "uno\r. dos . tres\x1f", "|bar|. •. -. x", "\n. \n", "b.\n. c", None, "fin. fin. fin"]


@pytest.fixture(scope="module")
def odd_documents(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    c = duckdb.connect()
    c.sql("create table d (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    for i, text in enumerate(t for t in ODD for _ in range(2)):  # each under an even id and an odd one
        c.execute("insert into d values (?, ?, 'es', 's', ?)", [i, text, len(text or "")])
    c.sql(f"copy d to '{os.path.join(folder, 'documents.parquet')}'")
    return folder


def both(spark, folder, name):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{os.path.join(folder, 'documents.parquet')}'")
    out = derived_plans.QUERIES[name](spark, folder)
    want = c.sql(f"select {', '.join(out.columns)} from ({derived_plans.SQL[name]})").fetchall()
    return sorted(map(tuple, out.collect())), sorted(want)


@pytest.mark.parametrize("name", ["tables_to_text", "placed_tables"])
def test_tables_of_odd_sentences_equal_their_sql(spark, odd_documents, name):
    got, want = both(spark, odd_documents, name)
    assert got == want


def test_blocks_of_pages_move_once(spark):
    schema = "page_id long, block_no int, block_id string, kind string, text string, row_idx int, col_idx int, left double, width double, selected boolean, children array<string>"
    rows = [
        (1, 0, "t", "TABLE", None, None, None, None, None, None, ["c", "gone"]),
        (1, 0, "c", "CELL", None, 1, 1, 0.1, 0.2, None, ["w", "s", "gone"]),
        (1, 0, "w", "WORD", "uno", None, None, 0.1, 0.1, None, None),
        (1, 0, "s", "SELECTION_ELEMENT", None, None, None, None, None, True, None),
        (1, 4, "l", "LINE", "uno", None, None, None, None, None, ["w"]),
        (1, 5, "m", "LINE", None, None, None, None, None, None, ["gone"]),
        (2, 6, "l", "LINE", "uno", None, None, None, None, None, ["w"]),
    ]
    blocks = spark.createDataFrame(rows, schema)
    cells, lines = tables.blocks_to_cells(blocks), tables.lines_outside_tables(blocks)
    for df in (cells, lines):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [(r["table_id"]["block_id"], r["row_idx"], r["col_idx"], r["text"], r["text_left"]) for r in cells.collect()] == [("t", 0, 0, "uno sí", 0.1)]
    assert sorted(map(tuple, lines.collect())) == [(1, 5, ""), (2, 6, "uno")]


def test_toxicity_learns_from_all_labelled_rows(spark):
    words = [f"marker{k}" for k in range(12)]
    rows = [(i, f"plain text about things number {i % 7}" + (f" {words[i // 3 % 12]} said" if i % 3 == 0 else ""), "en") for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _, _ in rows], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels, 40)  # more rows than a task holds at once
    found = {r["doc_id"]: r["score"] for r in toxicity.with_score(docs, net).collect()}
    assert all((found[i] >= 0.5) == (i % 3 == 0) for i, _, _ in rows)
    again = toxicity.fit(docs.unionByName(docs.filter("doc_id < 3")), labels, 1, 1)  # repeated rows, one row to a chunk
    assert len(set(again.scores(["", None]))) == 1


class Handle:
    """A state store of one response that counts the calls."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, []

    def __getattr__(self, name):
        def call(*given):
            self.calls += 1
            if name in ("getValueState", "getMapState"):
                return self
            if name == "get":
                return self.value
            if name == "update":
                self.value = given[0]
            elif name == "clear":  # of the map while it holds something, as only then is it cleared
                self.map = {}
            elif name == "registerTimer":
                self.timers.append(given[0])
            elif name == "deleteTimer":
                self.timers.remove(given[0])
            elif name == "updateValue":
                self.map[given[0]] = given[1]
            elif name == "getValue":
                return self.map.get(given[0])
            elif name == "containsKey":
                return given[0] in self.map
            elif name == "removeKey":
                self.map.pop(given[0])
            elif name == "iterator":
                return iter(self.map.items())

        return call


@pytest.mark.parametrize("near", [1 << 16, 40, 0])
def test_unordered_deltas_cost_few_calls_to_states(monkeypatch, near):
    monkeypatch.setattr(ordered, "NEAR_CHARS", near, raising=False)
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})()
    for seed in range(20):
        rng, handle = random.Random(seed), Handle()
        work = ordered.Sequencer((), ("done",), 0, 600_000)
        work.init(handle)
        deltas = [(n, "done" if n == 29 else "delta", f"piece {n} ") for n in range(30)]
        batches = [[] for _ in range(4)]
        for d in deltas:
            for _ in range(rng.randint(1, 2)):
                rng.choice(batches).append(d)
        told = []
        for k, batch in enumerate(batches):
            frame = pd.DataFrame(batch, columns=["sequence_number", "type", "delta"]).assign(at_ms=1000 * k)
            told += [f for f in work.handleInputRows((1,), iter([frame] if batch else []), clock)] if batch else []
        assert "".join(f["text"][0] for f in told) == "".join(d for *_, d in deltas) and not handle.map
        assert near < 1000 or handle.calls <= 2 + 1 + 2 * len(batches)


def test_a_wait_is_prolonged_when_its_first_end_is_reached():
    handle, now = Handle(), [0]
    clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self: now[0]})()
    work = ordered.Sequencer((), ("done",), 0, 1000)
    work.init(handle)
    for n, at in ((1, 0), (2, 700)):
        assert not list(work.handleInputRows((1,), iter([pd.DataFrame({"sequence_number": [n], "type": ["delta"], "delta": [f"x{n}"], "at_ms": [at]})]), clock))
    now[0] = 1000
    assert not list(work.handleExpiredTimer((1,), clock, None)) and handle.timers[-1] == 1700
    now[0] = 1700
    assert [f["text"][0] for f in work.handleExpiredTimer((1,), clock, None)] == ["x1x2"]
