"""Licence scans, spelling variants and token alignment against brute force, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("veridoc.llm")

from veridoc.llm import alignment, licenses, piece_bpe, pieces, queries, simple8b, spelling  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "  a  b ", "x\n\n y \tz", "aaaaaaaa aaaa", "a<|endoftext|>b c <|endoftext|> d", "tail ", "é́ ﬁ 😀😀", "a▁b ▁", "x\0y", "<s> </s>", "A" * 3000, "日本語のテキスト", "  a"]
GPL = "This work is licensed under the GNU General Public License, version 3."


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()] + ODD


def frame(spark, rows):
    """Rows with a null id, a repeated id and columns whose names clash with results."""
    ids = [None if i == 3 else 5 if i == 6 else i for i in range(len(rows))]
    return spark.createDataFrame([(i, t, "w", 1, "r") for i, t in zip(ids, rows, strict=True)], "doc_id long, text string, word string, n int, row string"), ids


def naive_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    stands = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    places = [(i, label) for p, label in licenses.BASE.items() for i in stands(p.split())]
    labels, score = {label for _, label in places}, 1.0 if places else 0.0
    base = sorted(labels)
    for label, notice, keys in licenses.TEMPLATES:
        ws = licenses.split_words(notice)
        for d in range(-len(ws), len(words) + 1):
            same = sum(0 <= d + q < len(words) and words[d + q] == w for q, w in enumerate(ws))
            if same < np.ceil(licenses.SHARE * len(ws)):
                continue
            at = [(next(i for i in range(len(ws)) if ws[i : i + len(k)] == k), k) for k in map(licenses.split_words, keys)]
            if all(any(abs(p - d - q) <= licenses.SLACK for p in stands(k)) for q, k in at):
                labels.add(label)
                score = max(score, same / len(ws))
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted(labels)), score)


def test_licenses_equal_brute_force(spark, texts):
    notice = licenses.TEMPLATES[1][1]
    words = notice.split()
    rows = texts[:40] + ODD + [
        GPL, GPL * 50, notice, notice.replace("free of charge", "free of charge indeed"), " ".join(words[: len(words) // 3]), " ".join(words[5:]),
        "x " * 30 + notice.upper() + " y" * 30, "cc by cc-by CC BY.", "License: ALL RIGHTS\nRESERVED", "éall rights reserved", "all rights réserved",
        "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0.", "version 2 0", "by cc", "a" * 5000 + " cc by", *[n for _, n, _ in licenses.TEMPLATES],
    ]
    docs, ids = frame(spark, rows)
    key = lambda r: tuple(map(str, r))
    got = sorted([tuple(r) for r in licenses.scan_licenses(docs).collect()], key=key)
    assert got == sorted([(i, *naive_licenses(t)) for i, t in zip(ids, rows, strict=True)], key=key)
    assert {x for r in got for x in r[6].split(",") if x} >= {label for label, _, _ in licenses.TEMPLATES}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_licence_index_does_not_depend_on_its_counts(texts):
    catalogue = licenses.Catalogue()
    rows = [t for t in texts] + [n for _, n, _ in licenses.TEMPLATES]
    rng = np.random.default_rng(5)
    first = catalogue.index(np.zeros(len(catalogue.words))).scan(rows)
    for _ in range(3):
        assert catalogue.index(rng.random(len(catalogue.words))).scan(rows) == first


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def naive_words(rows, ids, every=97):
    found = Counter()
    for i, t in zip(ids, rows, strict=True):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            found[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def naive_variants(words):
    out = {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(close), *((best, words[best]) if best is not None and words[best] >= 2 * n else (None, None)))
    root = lambda w: root(out[w][2]) if out[w][2] else w
    return sorted((w, *x, root(w)) for w, x in out.items())


def test_words_are_counted_as_the_rule_says(spark, texts):
    rows = texts + ["ÀÉÎ×÷ÿ " * 9, "q" * 200 + " " + "é" * 90, *["q" * 200 + " " + "é" * 90] * 4]
    docs, ids = frame(spark, rows)
    for every in (97, 2):
        got = {r["word"]: r["n"] for r in spelling.count_words(docs, every=every).collect()}
        assert got == naive_words(rows, ids, every)
    assert spelling.count_words(docs.limit(0)).count() == 0


def test_variants_equal_brute_force(spark):
    rng = random.Random(4)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 7))): rng.choice([3, 3, 4, 7, 9, 30, 70, 200]) for _ in range(500)}
    words |= {"aaaaa": 3, "aaaaaa": 6, "aaaaaaa": 12, "aaaaaaaa": 24, "z" * 300: 5, "z" * 301: 50, "z" * 150 + "y" + "z" * 150: 11, "zzzzzzy": 3}
    table = spark.createDataFrame([(w, n, n) for w, n in words.items()] + [(None, 9, 9)], "word string, n int, near int")
    want = naive_variants(words)
    for filter_words, round_bytes in ((spelling.FILTER_WORDS, spelling.ROUND_BYTES), (40, 1)):  # whole, and many rounds
        got = spelling.variants(table, filter_words=filter_words, round_bytes=round_bytes)
        assert sorted((r["word"], r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in got.collect()) == want
    assert spelling.variants(table.limit(0)).count() == 0
    assert spelling.variants(table.limit(1)).collect()[0]["n_near"] == 0


def test_filters_know_what_was_put_in():
    rng = np.random.default_rng(1)
    filters = spelling.Filters({5: 3, 70: 1}, 64)
    hashes = rng.integers(0, 2**63, 6000).astype(np.uint64)
    mixed, shard = filters.shards(hashes, np.full(6000, 5))
    assert set(shard.tolist()) == {0, 1, 2}
    filters.low, filters.high = 0, 3
    filters.bits = np.concatenate([np.frombuffer(filters.build(mixed[shard == k]), np.uint64) for k in range(3)])
    assert len(filters.holds(mixed, shard)) == 6000
    other, at = filters.shards(rng.integers(0, 2**63, 20000).astype(np.uint64), np.full(20000, 5))
    assert len(filters.holds(other, at)) < 1000


def naive_alignment(rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer_path(queries.BYTE_BPE))
    lib.encode_special_tokens = True
    a, b = alignment.byte_side(queries.tokenizer_path(queries.BYTE_BPE)), alignment.piece_side(queries.tokenizer_path(queries.PIECE_BPE))
    sp = piece_bpe.model(queries.tokenizer_path(queries.PIECE_BPE))[0].library
    per, count = [], Counter()
    for t in rows:
        x, y = (lib.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)) if t else ([], [])
        spelt = lambda side, ids: b"".join(side.raw[i] for i in ids)
        if not t or spelt(a, x) != (" " + t).encode() or spelt(b, y) != (" " + t).encode():
            x, y = [], []
        ends = lambda side, ids: np.cumsum([len(side.raw[i]) for i in ids]).tolist()
        ea, eb = ends(a, x), ends(b, y)
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y)) if max(([0] + ea)[i], ([0] + eb)[j]) < min(ea[i], eb[j])] if len(x) < 120 else None
        if links is None:  # the same by a walk
            links, i, j = [], 0, 0
            while i < len(x):
                links.append((x[i], y[j]))
                p, q = ea[i], eb[j]
                i, j = i + (p <= q), j + (q <= p)
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            p, q = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, x[i:p])) + "|" + ",".join(map(str, y[j:q])))
            i, j = p, q
        per.append((len(x), len(y), groups, links))
        count.update(set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    return [
        (n, m, len(groups), len(links), sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if n else "")
        for n, m, groups, links in per
    ]


def test_alignment_equals_brute_force(spark, texts):
    rows = [t for t in texts if not t or len(t) < 6000] + ODD
    docs, ids = frame(spark, rows)
    want = sorted([(str(i), *x) for i, x in zip(ids, naive_alignment(rows), strict=True)])
    a, b = queries.tokenizer_path(queries.BYTE_BPE), queries.tokenizer_path(queries.PIECE_BPE)
    for most in (alignment.BROADCAST_PAIRS, 50, 0):  # all pairs broadcast, a few, none
        got = alignment.link_statistics(docs, a, b, most)
        assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == want
    assert sum(x[1] == 0 for x in want) >= 4
    assert alignment.link_statistics(docs.limit(0), a, b).count() == 0


def test_merge_path_pieces_agree():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (5, 1), (40, 70), (300, 300)):
        last = 1000
        a, b = (np.append(np.sort(rng.choice(np.arange(1, last), k - 1, False)), last) for k in (n, m))
        union = np.union1d(a, b)
        at_a, at_b = np.searchsorted(a, union), np.searchsorted(b, union)
        both = np.isin(union, np.intersect1d(a, b))
        want = at_a.tolist(), at_b.tolist(), (np.cumsum(both) - both).tolist()
        for pieces_ in (1, 2, 3, 7, 64, 5000):
            assert tuple(x.tolist() for x in alignment.overlaps(a, b, pieces_)) == want


def test_memos_are_bounded_by_code_points(texts):
    path = queries.tokenizer_path(queries.BYTE_BPE)
    long = ["".join(random.Random(i).choices("abc+/=", k=3000)) for i in range(30)]
    rows = texts + long
    memo, free = pieces.PieceMemo(simple8b.LibraryEncoder(path), chars=20_000), pieces.PieceMemo(simple8b.LibraryEncoder(path))
    for lo in range(0, len(rows), 10):
        x, y = memo.ids(rows[lo : lo + 10]), free.ids(rows[lo : lo + 10])
        assert x[0].tolist() == y[0].tolist() and x[1].tolist() == y[1].tolist()
        brought = sum(len(t or "") for t in rows[lo : lo + 10])
        assert memo.held <= 20_000 + 2 * brought + 100
    bpe, all_known = piece_bpe.model(queries.tokenizer_path(queries.PIECE_BPE))
    small = piece_bpe.SegmentMemo(bpe, chars=5000)
    for lo in range(0, len(rows), 10):
        assert small(rows[lo : lo + 10]) == all_known(rows[lo : lo + 10])
        assert small.held <= 5000 + 2 * sum(len(t or "") for t in rows[lo : lo + 10])
