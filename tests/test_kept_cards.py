"""Cards made again only where samples changed; rows dealt by bytes; numbers over all rows."""

import random

import pytest
from pyspark.sql import functions as F

from veridoc.operators.balance import by_bytes
from veridoc.operators.index import sample_fragments, sample_hash
from veridoc.operators.kept_cards import KeptCards
from veridoc.operators.numbering import numbered
from veridoc.sources.corpus import manifest
from veridoc.sources.shared import shared_dir


def samples(spark, texts):
    rows = [(s, i, f"{s}--{i:03d}", t) for s, parts in texts.items() for i, t in enumerate(parts, 1)]
    return sample_fragments(spark.createDataFrame(rows, "stem string, chunk_index int, document_id string, text string"), 4)


def test_cards_are_made_once_and_again_when_their_sample_changes(spark):
    seen = []

    def make(chunks):
        seen.append({r["stem"] for r in chunks.select("stem").distinct().collect()})
        return chunks.groupBy("stem").agg(F.concat(F.lit("card of "), F.max("text")).alias("card"))

    cards = KeptCards(spark, shared_dir(spark, "cards"))
    texts = {f"d{i}": [f"t{i}-{k}" for k in range(i % 5 + 1)] for i in range(20)}

    def refresh():
        counts = cards.refresh(samples(spark, texts), make)
        want = {s: "card of " + max(r["text"] for r in rows) for s, rows in _by_stem(samples(spark, texts)).items()}
        held = cards.cards().collect()
        assert {r["stem"]: r["card"] for r in held} == want and len(held) == len(want)
        hashes = {r["stem"]: r["sample_hash"] for r in sample_hash(samples(spark, texts)).collect()}
        assert {r["stem"]: r["sample_hash"] for r in held} == hashes
        return counts, seen[-1]

    assert refresh() == ({"made": 20, "kept": 0, "removed": 0}, set(texts))
    version = cards._state()["version"]
    assert refresh() == ({"made": 0, "kept": 20, "removed": 0}, set()) and cards._state()["version"] == version
    old = texts["d3"]
    texts["d3"] = [*old[:-1], "changed"]
    assert refresh() == ({"made": 1, "kept": 19, "removed": 1}, {"d3"})
    del texts["d4"]
    texts["new"] = ["x"]
    assert refresh() == ({"made": 1, "kept": 18 + 1, "removed": 1}, {"new"})
    texts["d3"] = old  # back to an older text, whose old card is not shown twice
    assert refresh() == ({"made": 1, "kept": 19, "removed": 1}, {"d3"})
    for i in range(9):  # parts are merged in time
        texts["d5"] = [f"round {i}"]
        assert refresh()[0]["made"] == 1
    assert len(cards._state()["parts"]) <= 8


def _by_stem(sample):
    out = {}
    for r in sample.collect():
        out.setdefault(r["stem"], []).append(r)
    return out


def test_failed_and_partial_refreshes(spark):
    cards = KeptCards(spark, shared_dir(spark, "cards"))
    table = samples(spark, {"a": ["1"], "b": ["2"]})
    with pytest.raises(RuntimeError):
        cards.refresh(table, lambda _: (_ for _ in ()).throw(RuntimeError("model is away")))
    assert cards.cards().count() == 0
    only_a = lambda c: c.select("stem", F.when(F.col("stem") == "a", "card").alias("card"))
    assert cards.refresh(table, only_a) == {"made": 1, "kept": 0, "removed": 0}
    every = lambda c: c.select("stem", F.lit("card").alias("card"))
    assert cards.refresh(table, every) == {"made": 1, "kept": 1, "removed": 0}
    assert cards.refresh(table.limit(0), every) == {"made": 0, "kept": 0, "removed": 2}


def test_rows_are_dealt_by_bytes(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 2000)) for i in range(400)] + [(900, "y" * 120_000), (901, None), (902, "z" * 60_000)]
    table = spark.createDataFrame(rows, "id long, text string").repartition(3)
    dealt = by_bytes(table, "text", 20_000)
    assert sorted(map(tuple, dealt.collect()), key=str) == sorted(rows, key=str)
    sizes = [(r["n"], r["most"]) for r in dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("n"), F.max(F.octet_length("text")).alias("most")).collect() if r["n"]]
    small = sorted(n for n, most in sizes if most <= 2000)
    assert small[-1] <= 2 * small[len(small) // 2]
    assert all(n <= 20_000 + most for n, most in sizes)
    assert by_bytes(table.limit(0), "text").count() == 0


def test_numbers_are_those_of_one_ordered_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "cc"]), i) for i in range(500)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "k string, i long").repartition(5)
    got = {(r["k"], r["i"]): r["at"] for r in numbered(table, ["k", "i"], "at").collect()}
    assert got == {r: n for n, r in enumerate(sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])))}
    assert numbered(table.limit(0), ["k"], "at").count() == 0


def test_manifest_refuses_too_many_keys(spark):
    row = spark.range(1).select(F.lit("d").alias("document_id"), F.lit("t").alias("tipo"), F.lit(1).alias("anio"), F.lit("f").alias("fuente"), F.lit(1).alias("caracteres"), F.map_from_arrays(F.array(*[F.lit(f"k{i}") for i in range(6)]), F.array_repeat(F.lit("v"), 6)).alias("extra"))
    assert len(manifest(row, 6).columns) == 11
    with pytest.raises(ValueError):
        manifest(row, 5)
