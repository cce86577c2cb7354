"""Training-data operators against libraries, brute force, round trips and held-out labels."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("veridoc.llm")

from veridoc.llm import chat, common, fingerprints, importance, media, near_dedup, packing, piece_bpe, queries, simple8b, token_counts, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "  a  b ", "x\n\n y \tz", "aaaaaaaa aaaa", "a<|endoftext|>b c <|endoftext|> d<|endoftext|>", "it's 3rd  ", " lead", "tail ", "é́ ﬁ 😀😀", "a▁b ▁", "x\0y", "<s> </s>", "  ", "A" * 3000]


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return [r[0] for r in duckdb.sql(f"select text from '{SF}/documents.parquet' order by doc_id").fetchall()] + ODD


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "n", 1) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens string, key int")


def encoded(texts):
    ids, counts = simple8b.encoder(queries.tokenizer_path("byte_bpe_50k.json")).ids(texts)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_token_counts_equal_the_library(texts):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert token_counts.count_texts(texts, path) == want
    assert encoded(texts) == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    memo = simple8b.PieceMemo(simple8b.LibraryEncoder(path), limit=50)  # much is forgotten between blocks
    again = [x for lo, hi in common.blocks(texts, 2000) for x in np.split(*[f(y) for f, y in zip((lambda a: a, lambda n: np.cumsum(n)[:-1]), memo.ids(texts[lo:hi]), strict=True)])]
    assert [x.tolist() for x in again] == encoded(texts)


def test_pieces_equal_the_library(texts):
    bpe, memo = piece_bpe.model(queries.tokenizer_path("piece_bpe_32k.model"))
    ids = [np.frombuffer(x, "<u4").tolist() for x in memo(texts)]
    want = bpe.library.encode([t or "" for t in texts])
    assert ids == want
    assert [bpe.decode([1, *x, 2]) for x in ids] == [bpe.library.decode([1, *x, 2]) for x in want]


def test_simple8b_round_trip():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 511, 512, 513, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        x >>= rng.integers(0, 64, n).astype(np.uint64)
        x[rng.random(n) < 0.5] = 0
        sizes = simple8b.block_sizes(np.array([n // 3, 0, n - n // 3]))
        assert (simple8b.decode_ids(*simple8b.encode_ids(x, sizes), sizes) == x).all()
    file = simple8b.TokenFile()
    for doc_id, ids in ((3, [7, 2**61]), (None, [9]), (4, []), (5, [2**63, 1, 2**62])):
        x = np.array(ids, np.uint64)
        file.add(doc_id, len(x), *simple8b.encode_ids(x, simple8b.block_sizes([len(x)])))
    named, counts, ids = simple8b.unpack_file(file.pack())
    assert named.tolist() == [3, common.NO_ID, 4, 5] and counts.tolist() == [2, 1, 0, 3] and ids.tolist() == [7, 2**61, 9, 2**63, 1, 2**62]


def test_token_files(spark, texts):
    from tokenizers import Tokenizer

    root = common.shared_dir(spark, "test-files")
    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    docs = frame(spark, texts)
    index = simple8b.write_token_files(docs, root, path, end_id=2, file_ids=20_000)
    simple8b._save(f"{root}/files", "ids-left-by-a-lost-task.s8b", b"half")
    rows = simple8b.with_crc(simple8b.read_token_files(spark, root, index)).orderBy("doc_id").collect()
    at = 0
    for i, (row, text) in enumerate(zip(rows, texts, strict=True)):
        own = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens) == (i, at, len(own) // 4) and bytes(row.ids) == own and row.ids_crc32 == zlib.crc32(own)
        at += row.n_tokens
    empty = common.shared_dir(spark, "test-empty")
    assert simple8b.read_token_files(spark, empty, simple8b.write_token_files(docs.limit(0), empty, path)).count() == 0
    odd = spark.createDataFrame([(None, "b", 1), (7, "a a", 2), (7, None, 3), (None, "c c c", 4)], "doc_id long, text string, part int")
    held = common.shared_dir(spark, "test-odd")
    rows = simple8b.read_token_files(spark, held, simple8b.write_token_files(odd, held, path, end_id=2)).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, None, 7, 7] and sorted(r.n_tokens for r in rows) == [1, 2, 3, 4] and rows[-1].start + rows[-1].n_tokens == 10


def test_fingerprints(spark, texts):
    s = fingerprints.sketches(texts)
    assert (s == np.vstack([fingerprints.sketches([t]) for t in texts])).all()
    long = next(t for t in texts if t and len(t) > 3000)
    near = lambda a, b: fingerprints.likeness(fingerprints.sketches([a]), fingerprints.sketches([b]))[0]
    assert near(long, "wholly new start " + long) > 0.9 and near("", None) == 1 and near(long, "") == 0
    rows = fingerprints.compare_with_edits(frame(spark, texts)).orderBy("doc_id").collect()
    for i, r in enumerate(rows):
        t, u = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        edited = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(t)
        assert r.near_edited == near(t, edited) and r.near_next == near(t, u)
    assert fingerprints.compare_with_edits(frame(spark, [])).count() == 0
    assert fingerprints.compare_with_edits(frame(spark, ["solo"])).first().near_next == 1.0


def test_media(spark, texts):
    rows = [*texts, texts[0], "x" * 9000, "y" + "x" * 9000]
    got = {r.doc_id: r for r in media.read_media(spark, media.store_media(frame(spark, rows))).collect()}
    for i, t in enumerate(rows):
        p = media.payload(t)
        assert len(p) % 64 == 0 and len(p) >= 64
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-64:]) and got[i].n_bytes == len((t or "").encode())
    assert got[0].media_sha256 == got[len(texts)].media_sha256
    assert media.read_media(spark, media.store_media(frame(spark, []))).count() == 0
    cuts = media.cut_points([b"z" + media.payload(rows[0])])[0]
    old = media.cut_points([media.payload(rows[0])])[0]
    assert {c - 1 for c in cuts} & set(old) and max(np.diff([0, *cuts])) <= media.MOST


def brute_classes(texts):
    bags = [Counter() for _ in texts]
    for bag, t in zip(bags, texts, strict=True):
        w = (t or "").lower().split(" ")
        w = [x for x in " ".join(w).replace("\n", " ").replace("\t", " ").split(" ") if x]
        if w:
            bag.update(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both, either = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if (texts[i] or "") == (texts[j] or "") or (either and both / either >= 0.8):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("many,block_rows,block_bytes", [(8, 4096, 1 << 25), (1, 16, 1 << 25), (1, 40, 2000)])
def test_near_duplicates_equal_brute_force(spark, texts, monkeypatch, many, block_rows, block_bytes):
    monkeypatch.setattr(near_dedup, "MANY", many)
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", block_bytes)
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(60)]
    rows = [t for t in texts if t and "\0" not in t and " " not in t][:120] + ["", None, "uno", "uno", "Uno", "a b c d"]
    base = [word() for _ in range(150)]
    for k in range(40):  # a group of near copies, and many texts that share a passage only
        copy = list(base)
        copy[rng.randrange(150)] = word()
        rows.append(" ".join(copy))
        rows.append(" ".join([word() for _ in range(60)] + passage + [word() for _ in range(40)]))
    chain = [word() for _ in range(120)]
    for k in range(6):  # each near the one before
        chain = chain[:4 * k] + [word() for _ in range(3)] + chain[4 * k + 3 :]
        rows.append(" ".join(chain))
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(frame(spark, rows)).collect()}
    assert [got[i] for i in range(len(rows))] == brute_classes(rows)
    assert near_dedup.near_duplicate_classes(frame(spark, [])).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(2)
    est, true = [], []
    for _ in range(60):
        x = rng.integers(0, 2**62, 40).astype(np.uint64)
        wa, wb = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        owner = np.concatenate([np.zeros((wa > 0).sum(), int), np.ones((wb > 0).sum(), int)])
        s = near_dedup.signatures(owner, np.concatenate([x[wa > 0], x[wb > 0]]), np.concatenate([wa[wa > 0], wb[wb > 0]]), 2)
        est.append((s[0] == s[1]).mean())
        true.append(np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum())
    assert abs(np.mean(est) - np.mean(true)) < 0.02


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    rows = queries.op4_toxicity(spark, sf).join(labels, "doc_id").filter("held_out").toPandas()
    order = rows["score"].rank()
    pos = rows["toxic"] == 1
    auc = (order[pos].mean() - (pos.sum() + 1) / 2) / (~pos).sum()
    assert auc > 0.95 and (rows["predicted"] == rows["toxic"]).mean() > 0.95
    assert rows[~pos]["rejected"].mean() < 0.03
    assert toxicity.fit(docs, labels.limit(0)) is None
    blank = toxicity.with_score(frame(spark, ["", None, "x"]), None).collect()
    assert [r.score for r in blank] == [0.0] * 3


def test_importance_resampling(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = queries.table(spark, sf, "documents"), queries.table(spark, sf, "labels")
    out, ratio, _ = importance.resample(docs, labels)
    rows = out.join(labels, "doc_id").toPandas()
    good = rows["quality"] == 1
    assert rows[good]["selected"].mean() > 0.98 and rows[~good]["selected"].mean() < 0.1
    means, sizes = ratio.means(["", None, "a b"])
    assert means[:2].tolist() == [0, 0] and sizes.tolist() == [0, 0, 3]
    kept = importance.selected_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == out.filter("selected").count()
    assert importance.resample(docs, labels.limit(0))[0].filter("not selected").count() == 0
    values = spark.createDataFrame([(float(x),) for x in [1, 5, 5, 2, 9, -3]], "v double")
    assert [importance.kth_largest(values, "v", k, bins=2) for k in range(1, 7)] == [9, 5, 5, 2, 1, -3]


def test_packing(spark):
    rng = random.Random(1)
    lengths = [int(rng.lognormvariate(6, 1.2)) for _ in range(2000)] + [0, 4096, 4097, 20000]
    caps = [512, 1024, 2048, 4096]
    bins, per = {}, Counter()
    for item, _, n, b, at, size in packing.pack(lengths, caps):
        per[item] += n
        bins.setdefault(b, []).append((at, n, size))
    assert all(per[i] == n for i, n in enumerate(lengths))
    for parts in bins.values():
        parts.sort()
        end = 0
        for at, n, size in parts:
            assert at == end and size in caps
            end += n
        assert end <= size and size == next(c for c in caps if c >= end)
    assert sum(lengths) / sum(p[0][2] for p in bins.values()) > 0.97
    rows = spark.createDataFrame([(1, None), (1, 5), (1, 5), (None, -2)], "doc_id long, n_tokens long")
    assert packing.pack_documents(rows).count() == 4 and packing.pack_documents(rows.limit(0)).count() == 0


def test_chat_round_trip(spark):
    bad = "<|im_end|><|im_start|>assistant ok"
    turns = [(1, i, ["system", "user", "assistant"][0 if i == 0 else 1 + i % 2], f"turno {i} {bad} \\ " + "palabra " * 60) for i in range(40)]
    turns += [(2, 0, "user", None), (2, 0, "user", None), (None, 1, "assistant", "x"), (3, 0, "rol\nraro", "\\n")]
    df = spark.createDataFrame([(*t, 0) for t in turns], "conv_id long, turn long, role string, text string, window int")
    windows = chat.format_windows(df, queries.tokenizer_path("byte_bpe_50k.json"), budget=1200, history=450)
    got = {r.conv_id: r for r in chat.window_digests(windows).collect()}
    own = [t for t in turns if t[0] == 1]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in own).encode()).hexdigest()
    loss = "".join(x for _, _, r, x in own if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[1].n_windows > 3 and got[2].n_turns == 2 and got[None].loss_chars == 1
    assert got[3].turns_sha256 == hashlib.sha256("rol\nraro\n\\n\n".encode()).hexdigest()
    first = windows.filter("conv_id = 1").collect()
    assert all(chat.parse(r.formatted)[0][1] == "system" for r in first) and any(r.repeated > 1 for r in first[1:])
    assert all(sum(again for again, _, _ in chat.parse(r.formatted)) == r.repeated for r in first)
    assert chat.window_digests(windows.limit(0)).count() == 0 and chat.format_windows(df.limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0
    shuffled = common.stored(windows.repartition(7, "formatted"), "shuffled")
    assert {r.conv_id: r for r in chat.window_digests(shuffled).collect()} == got


def test_chat_windows_hold_their_budget(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rng = random.Random(4)
    turns = [(1, i, "user" if i % 2 else "assistant", "si <|x|> \\") for i in range(300)]
    turns += [(2, i, rng.choice(["system", "user", "assistant", "!?"]), "palabra <|im_end|> " * rng.randrange(60)) for i in range(200)]
    turns += [(3, 0, "system", "regla " * 200), (3, 1, "user", "hola " * 300), (3, 2, "assistant", "si"), (3, 3, "user", "hola " * 900), (3, 4, "assistant", "no")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    given = queries.table(spark, "/root/testdata/sf0.01", "conversations").select(*df.columns)
    for table, budget, history in ((df, 512, 128), (df, 400, 0), (given, 1024, 256)):
        rows = chat.format_windows(table, path, budget, history).collect()
        for r in rows:
            n = len(lib.encode(r.formatted, add_special_tokens=False).ids)
            assert n <= budget or len(chat.parse(r.formatted)) == 1
        assert sum(len(chat.parse(r.formatted)) - r.repeated for r in rows) == table.count()


def test_pipeline_keeps_clean_and_drops_marked(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "packing"]
    sf = "/root/testdata/sf0.01"
    docs = queries.table(spark, sf, "documents")
    out = pipeline.run(spark, sf)
    kept = out.select("doc_id").distinct()
    labels = queries.table(spark, sf, "labels")
    assert kept.join(labels.filter("quality = 0"), "doc_id").count() <= 0.1 * labels.filter("quality = 0").count()
    classes = near_dedup.near_duplicate_classes(docs.join(kept, "doc_id", "left_semi"))
    assert classes.groupBy("class_id").count().filter("count > 1").count() == 0
    # of 51 toxic rows among 399 labels most are gone, though so few labels teach few of their words; clean ones whose
    # text is not a copy are kept
    toxic, clean = labels.filter("toxic = 1"), labels.filter("toxic = 0 and quality = 1")
    assert kept.join(toxic, "doc_id").count() <= 0.4 * toxic.count()
    first = near_dedup.near_duplicate_classes(docs).filter("doc_id = class_id")
    alone = clean.join(first, "doc_id", "left_semi")
    assert kept.join(alone, "doc_id").count() >= 0.95 * alone.count()
    # each document's pieces hold its tokens and an end token, and no sequence holds more than its length
    counts = token_counts.count_tokens(docs.join(kept, "doc_id", "left_semi"), queries.tokenizer_path(queries.BYTE_BPE))
    sums = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg({"piece_tokens": "sum"}).withColumnRenamed("sum(piece_tokens)", "n").collect()}
    assert sums == {r["doc_id"]: r["n_tokens"] + 1 for r in counts.collect()}
    bins = {}
    for r in out.collect():
        bins.setdefault(r["bin_id"], []).append((r["bin_offset"], r["piece_tokens"], r["bin_length"]))
    for parts in bins.values():
        ends = [at + n for at, n, _ in sorted(parts)]
        assert [at for at, _, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= parts[0][2]


def test_toxicity_network_equals_naive_convolution_and_numeric_gradient():
    rng = np.random.default_rng(6)
    net = toxicity.TextCnn(np.arange(20), rng.normal(0, 1, (21, toxicity.EMBEDDING)), [rng.normal(0, 0.5, (w, toxicity.EMBEDDING, toxicity.FILTERS)) for w in toxicity.WIDTH_SIZES], rng.normal(0, 0.1, 24), rng.normal(0, 0.5, 24), 0.3)
    net.table[0] = 0
    words = [rng.integers(0, 21, (n, 3)) * (rng.random((n, 1)) < 0.4) for n in (0, 1, 7, 30)]
    got = net.logits(*toxicity._padded(np.concatenate(words), np.array(list(map(len, words)))))
    for text, logit in zip(words, got, strict=True):
        x = np.vstack([net.table[text].sum(axis=1), np.zeros((2, toxicity.EMBEDDING))]) if len(text) else np.zeros((2, toxicity.EMBEDDING))
        pool = [max([0.0, *[sum(x[i + j] @ w[j] for j in range(len(w)))[f] for i in range(len(text))]]) for w in net.filters for f in range(toxicity.FILTERS)]
        assert abs(np.maximum(np.array(pool) + net.bias, 0) @ net.out + net.out_bias - logit) < 1e-4
        near = toxicity.around_active(text)
        assert abs(net.logits(*toxicity._padded(near, np.array([len(near)])))[0] - logit) < 1e-4
    index, begins = toxicity._padded(np.concatenate(words), np.array(list(map(len, words))))
    y, weight = np.array([0, 1, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])

    def loss():
        p = 1 / (1 + np.exp(-net.logits(index, begins)))
        return -(weight * (y * np.log(p) + (1 - y) * np.log(1 - p))).mean()

    grads = toxicity.gradients(net, index, begins, y, weight)
    for param, grad in zip([net.table[1:], *net.filters, net.bias, net.out], [grads[0][1:], *grads[1:-1]], strict=True):
        for at in [tuple(rng.integers(0, n) for n in param.shape) for _ in range(12)]:
            held = param[at]
            param[at] = held + 1e-2
            up = loss()
            param[at] = held - 1e-2
            down = loss()
            param[at] = held
            assert abs((up - down) / 2e-2 - grad[at]) < 2e-2


def test_importance_equals_naive_ratio_and_sorted_keys(spark):
    import math
    import re

    from pyspark.sql import functions as F

    labels = queries.table(spark, SF, "labels")
    given = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows = given + [(10**6 + i, t) for i, t in enumerate(ODD)] + given[:2] + [(None, "uno dos dos"), (None, None)]
    docs = common.stored(spark.createDataFrame([(*r, 0.5, 1) for r in rows], "doc_id long, text string, mean double, bucket int"), "odd-docs")
    out, _, _ = importance.resample(docs, labels)
    _, cut = importance.fit(docs, labels)
    of = {}

    def bucket(gram):
        if gram not in of:
            of[gram] = int(importance.ngram_buckets([" ".join(gram)])[0][-1])
        return of[gram]

    def grams(text):
        words = re.findall(r"[!-/:-@\[-`{-\x7f]+|[^\t\n\x0b\x0c\r !-/:-@\[-`{-\x7f]+", text or "")
        return [bucket((w,)) for w in words] + [0 if a == b else bucket((a, b)) for a, b in zip(words, words[1:])]

    quality = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None}
    judge = lambda i: zlib.crc32(str(i).encode()) % importance.CUT_SHARE == 0
    found = [grams(t) for _, t in rows]
    target = Counter(b for (i, _), g in zip(rows, found, strict=True) if quality.get(i, 0) > 0 and not judge(i) for b in g)
    raw = Counter(b for g in found for b in g)
    n, all_raw, size = sum(target.values()), sum(raw.values()), importance.BUCKETS
    ratio = {b: math.log((target[b] + size * raw[b] / all_raw + 1e-9) / (n + size)) - math.log((raw[b] + 1e-9) / all_raw) for b in raw}
    means = [sum(ratio[b] for b in g) / max(1, len(g)) for g in found]
    judged = {}
    for (i, _), m in zip(rows, means, strict=True):
        if i in quality and judge(i):
            judged[i] = min(m, judged.get(i, m))
    good, bad = [m for i, m in judged.items() if quality[i] > 0], [m for i, m in judged.items() if not quality[i] > 0]
    assert good and bad and n
    right = lambda c: sum(m > c for m in good) / len(good) + sum(m <= c for m in bad) / len(bad)
    assert right(cut) == pytest.approx(max(map(right, [-math.inf, *judged.values()])))
    noise = {r.doc_id: ((r.h % 2**64 >> 11) + 0.5) / 2**53 for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(13)).alias("h")).collect()}
    keys = [m * importance.WEIGHT_NGRAMS - math.log(-math.log(noise[i])) for (i, _), m in zip(rows, means, strict=True)]
    k = sum(m > cut for m in means)
    limit = sorted(keys, reverse=True)[k - 1]
    by = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = sorted([(i, len(g), m, key, key >= limit - 1e-9) for (i, _), g, m, key in zip(rows, found, means, keys, strict=True)], key=by)
    got = sorted([tuple(r) for r in out.collect()], key=by)
    assert 0 < k < len(rows) and len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:2] == b[:2] and a[4] == b[4] and a[2:4] == pytest.approx(b[2:4], abs=1e-6)


def naive_pack(lengths, capacities):
    """The same rules over plain lists: every open bin and every remaining piece is looked at each time."""
    largest, out, pieces, bins = max(capacities), [], [], []
    for i, n in enumerate(lengths):
        while_full = n // largest
        for k in range(while_full):
            bins.append({"left": 0, "touched": -1, "parts": [(i, k, largest)]})
        if n % largest or not while_full:
            pieces.append((i, while_full, n % largest))
    pieces.sort(key=lambda p: (-p[2], p[0]))
    fits = lambda n: min(c for c in capacities if c >= n)

    def price(size, capacity, rest):
        held = size
        for n in rest:
            if n and held + n <= capacity:
                held += n
        held = max(1, held)
        length = fits(held)
        return (packing.BIN_COST + length + length**2 / packing.ATTENTION) / held

    for at, (i, k, n) in enumerate(pieces):
        open_bins = [b for b in bins if b["touched"] >= 0 and b["left"] >= n]
        if open_bins:
            b = min(open_bins, key=lambda b: (b["left"], -b["touched"]))
        else:
            rest = [p[2] for p in pieces[at + 1 :]]
            b = {"left": min((c for c in capacities if c >= n), key=lambda c: (price(n, c, rest), c)), "parts": []}
            bins.append(b)
        b["parts"].append((i, k, n))
        b["left"], b["touched"] = b["left"] - n, at
    for number, b in enumerate(bins):
        at, length = 0, fits(sum(n for _, _, n in b["parts"]))
        for i, k, n in b["parts"]:
            out.append((i, k, n, number, at, length))
            at += n
    return sorted(out)


@pytest.mark.parametrize("capacities", [[512, 1024, 2048, 4096], [7, 20], [64]])
def test_packing_equals_naive_best_fit(spark, capacities):
    rng = random.Random(8)
    for n in (0, 1, 2, 40, 250):
        lengths = [min(3 * max(capacities), int(rng.lognormvariate(np.log(max(capacities)) - 2.5, 1.3))) for _ in range(n)] + [0, 0, max(capacities), 5, 5]
        assert sorted(packing.pack(lengths, capacities)) == naive_pack(lengths, capacities)
    docs = spark.createDataFrame([(i, x, "clash", 3) for i, x in enumerate(lengths)], "doc_id long, n_tokens long, bin_id string, n int")
    got = sorted(tuple(r) for r in packing.pack_documents(docs, capacities=tuple(capacities)).collect())
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    want = sorted((order[i], k, k * max(capacities), size, f"0-{b}", at, length) for i, k, size, b, at, length in naive_pack([lengths[i] for i in order], capacities))
    assert got == want


def test_token_frames_with_odd_rows(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    rows = [(None, "a b"), (7, None), (7, ""), (7, ""), (8, "<s> hola ▁x"), (9, "palabra " * 30_000)]
    odd = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, n_tokens string, ids int")
    lib, piece = Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json")), sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    counts = [tuple(r) for r in token_counts.count_tokens(odd, queries.tokenizer_path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens").collect()]
    by = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(counts, key=by) == sorted([(i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t in rows], key=by)
    coded = [(r.doc_id, bytes(r.ids), r.decoded) for r in piece_bpe.encode_decode(odd, queries.tokenizer_path("piece_bpe_32k.model")).collect()]
    want = [(i, np.array(x := piece.encode(t or "", add_bos=True, add_eos=True), "<u4").tobytes(), piece.decode(x)) for i, t in rows]
    assert sorted(coded, key=by) == sorted(want, key=by)
    assert token_counts.count_tokens(odd.limit(0), queries.tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert piece_bpe.encode_decode(odd.limit(0), queries.tokenizer_path("piece_bpe_32k.model")).count() == 0


def test_pipeline_stages_with_odd_rows(spark):
    from pyspark.sql import functions as F

    pipeline = pytest.importorskip("corpus_pipeline")
    some = queries.table(spark, SF, "documents").orderBy("doc_id").limit(4)
    none = some.limit(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in some.schema])
    blank = none.withColumn("doc_id", F.lit(10**9).cast(some.schema["doc_id"].dataType)).withColumn("text", F.lit(""))
    long = none.withColumn("doc_id", F.lit(10**9 + 1).cast(some.schema["doc_id"].dataType)).withColumn("text", F.repeat(F.lit("palabra larga "), 20_000))
    odd = some.unionByName(some).unionByName(none).unionByName(none).unionByName(blank).unionByName(long)
    odd = common.stored(odd.withColumns({c: F.lit(1) for c in ("_ratio", "_ratio_mean", "_near_id", "score", "label", "key", "id", "n", "band")}), "odd-rows")
    for name, stage in pipeline.STAGES:
        out = stage(spark, odd, SF)
        assert stage(spark, odd.limit(0), SF).count() == 0
        if name == "packing":
            assert out.groupBy("doc_id").count().count() == 7  # null ids are one group here
            counts = token_counts.count_tokens(odd, queries.tokenizer_path(queries.BYTE_BPE))
            assert out.agg(F.sum("piece_tokens")).first()[0] == counts.agg(F.sum(F.col("n_tokens") + 1)).first()[0]
        else:
            assert out.columns == odd.columns and out.exceptAll(odd).isEmpty() and out.count() > 0
