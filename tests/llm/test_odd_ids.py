"""Null, repeated and very large ids through the operators that gather by id, and a naive parse of fingerprints."""

import random
from itertools import groupby

import pytest

pytest.importorskip("veridoc.llm")

from pyspark.sql import functions as F  # noqa: E402

from veridoc.llm import fingerprints, media, near_dedup, packing  # noqa: E402

WORD, STEP = 2**64 - 1, 0x9E3779B97F4A7C15


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))


def toss(labels):
    out = []
    for i, x in enumerate(labels):
        differ = x ^ labels[i - 1] if i else 1
        bit = (differ & -differ).bit_length() - 1
        out.append(2 * bit + (x >> bit & 1))
    return out


def mixed(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 & WORD
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D & WORD
    return x ^ x >> 33


def naive_sketch(text):
    names, best = [ord(c) for c in text or ""], {}
    for level in (1, 2, 3):
        runs = [(s, len(list(g))) for s, g in groupby(names)]
        labels = toss(toss(toss([s for s, _ in runs])))
        names, phrase = [], []
        for i, run in enumerate(runs):
            peak = 0 < i < len(runs) - 1 and labels[i - 1] < labels[i] > labels[i + 1]
            if peak:
                names.append(phrase)
                phrase = []
            phrase.append(run)
        names = [mixed(sum((s + (n - 1) * STEP + 1) * pow(STEP, k + 1, 2**64) for k, (s, n) in enumerate(p)) + level & WORD) for p in [*names, phrase] if p]
        for x in names if level > 1 else []:
            best[x & 127] = min(best.get(x & 127, WORD), x)
    return [min(best[k] >> 8 & 0xFFFF, 0xFFFE) if k in best else 0xFFFF for k in range(128)]


def test_fingerprints_equal_a_naive_parse():
    rng = random.Random(8)
    texts = [None, "", "a", "aaaa", "ab", "aba", "abcabcabc" * 20, "é😀" * 30, *[prose(rng, n) for n in (1, 2, 5, 40, 300, 3000)], "x" * 999 + "y" + "x" * 999]
    assert fingerprints.sketches(texts).tolist() == [naive_sketch(t) for t in texts]


def test_fingerprints_keep_null_and_repeated_ids(spark):
    rows = [(None, "one text"), (None, None), (7, "seven"), (7, "other"), (7, "seven"), (2**53 + 1, "big")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_chars"], r["fingerprint"]) for r in fingerprints.fingerprint(docs).collect())
    assert got == sorted((str(i), len(t or ""), fingerprints.as_text(fingerprints.sketches([t]))[0]) for i, t in rows)


def test_packing_keeps_large_ids_beside_null(spark):
    rows = [(2**53 + 1, 10), (None, 20), (2**63 - 1, 30), (-(2**63), 5000), (None, None), (2**53 + 1, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.pack_documents(docs).collect()
    totals = {}
    for r in got:
        totals[r["doc_id"]] = totals.get(r["doc_id"], 0) + r["piece_tokens"]
    assert totals == {2**53 + 1: 20, None: 20, 2**63 - 1: 30, -(2**63): 5000}
    names = spark.createDataFrame([("b", 3), (None, 2), ("a", 3)], "doc_id string, n_tokens int")
    assert sorted((r["doc_id"] or "", r["piece_tokens"]) for r in packing.pack_documents(names).collect()) == [("", 2), ("a", 3), ("b", 3)]
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_media_of_rows_without_ids_share_chunks_in_bounded_sets(spark):
    rng = random.Random(3)
    rows = [(None if i % 3 else 5, t) for i, t in enumerate(prose(rng, 150) for _ in range(5000))] * 2  # 10,000 rows, each text twice
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    path = media.store_media(docs)
    table = spark.read.parquet(path)
    sizes = table.select(F.size("owned").alias("n"), (F.length("form") / 20).alias("chunks"))
    assert sizes.filter("n > chunks").count() == 0
    got = media.read_media(spark, path)
    want = docs.select("doc_id", F.sha2(F.encode(F.concat("text", F.repeat(F.lit("\0"), (64 - F.octet_length("text") % 64) % 64)), "UTF-8"), 256).alias("payload_sha256"))
    assert got.select("doc_id", "payload_sha256").exceptAll(want).count() == want.exceptAll(got.select("doc_id", "payload_sha256")).count() == 0
    assert media.read_media(spark, media.store_media(docs.limit(0))).count() == 0


def test_classes_of_one_id_over_two_texts_have_keys_of_their_own(spark):
    rng = random.Random(6)
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " end"), (3, b), (4, b), (None, c), (None, c + " end"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicate_classes(docs).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["class_key"], []).append((r["doc_id"], r["class_id"], r["n_copies"]))
    assert sorted(map(len, groups.values())) == [1, 2, 2, 3]
    assert all(n == len(g) and i == min((d for d, _, _ in g if d is not None), default=None) for g in groups.values() for _, i, n in g)
