"""SentencePiece chunks, fill-in-the-middle and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from seqspark.llm import fim, importance, pieces, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", None, "One two,  three", " ", "   lead and trail  ", "▁ marks▁▁here", "naïve café — 日本語 😀 á", "x\x00y \x00", "<s> </s> <unk>", "tab\tnew\nline\r\n", "same same", "same same", "e" * 5000, "a b " * 3000, "<P>held", "it's 12,345 I'll", " 　 wide", "İstanbul ẞ ſ"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(10 * i if i != 5 else None, t, "extra", i) for i, t in enumerate(texts)], "doc_id long, text string, n string, ids int")


def fuzz(n, seed, alphabet="ab ▁\t\n\x00é日😀<>PSM1"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_pieces_are_those_of_the_library(spark):
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert pieces.pieces(MODEL).separable
    texts = TEXTS + fuzz(500, 1)
    encoded = pieces.piece_encode(table(spark, texts), MODEL, last=2)
    expected = [theirs.encode(t or "", add_eos=True) for t in texts]
    assert sorted(r.ids for r in encoded.collect()) == sorted(expected)
    assert sorted(r.decoded for r in pieces.piece_decode(encoded, MODEL).collect()) == sorted(theirs.decode(x) for x in expected)
    assert pieces.piece_encode(table(spark).limit(0), MODEL).count() == 0


def test_texts_in_any_company_have_the_same_ids(monkeypatch):
    p, texts = pieces.pieces(MODEL), [(t or "").encode() for t in TEXTS + fuzz(300, 2)]
    alone = [next(p.encode([t])).tolist() for t in texts]
    assert [x.tolist() for x in p.encode(texts)] == alone
    monkeypatch.setattr(pieces, "BLOCK", 64)
    assert [x.tolist() for x in p.encode(texts)] == alone
    monkeypatch.setattr(p, "separable", False)
    assert [x.tolist() for x in p.encode(texts)] == alone


def plain_fim(doc_id, text, percent=90, share=20):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < share:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("share", [20, 100])
def test_middles(spark, share):
    texts = TEXTS + fuzz(600, 3)
    df = table(spark, texts).withColumn("cut", fim.F.lit(1))
    made = fim.fill_in_middle(df, suffix_first=share)
    got = made.select("*", fim.restored(fim.F.col("output"), fim.F.col("form")).alias("again")).collect()
    expected = [plain_fim(10 * i if i != 5 else None, t or "", share=share) for i, t in enumerate(texts)]
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, expected))
    assert sorted(r.again for r in got) == sorted(t or "" for t in texts)
    assert {r.form for r in got} >= {"plain", "spm"}
    assert fim.fill_in_middle(df.limit(0)).count() == 0


def test_wavelet_matrix_counts_classes():
    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 4, 1000).astype(np.uint8)
    m, at = fim.WaveletMatrix(kinds, 2), np.arange(1001)
    for k in range(4):
        assert np.array_equal(m.rank(k, at), np.concatenate(([0], np.cumsum(kinds == k))))
    assert fim.WaveletMatrix(kinds[:0], 2).rank(3, np.array([0])).tolist() == [0]


def test_cuts_do_not_depend_on_blocks(spark, monkeypatch):
    import pyarrow as pa

    texts, draws = pa.array([t or "" for t in TEXTS] + fuzz(200, 4)), pa.array(np.random.default_rng(1).integers(0, 2**32, 218))
    whole = fim._cut_texts(texts, draws, draws.take(pa.array(range(217, -1, -1))))
    monkeypatch.setattr(fim, "BLOCK", 50)
    assert fim._cut_texts(texts, draws, draws.take(pa.array(range(217, -1, -1)))).equals(whole)


def test_cuts_of_whole_words_of_bits():
    for size in (1, 62, 63, 64, 127, 128, 191):
        data = np.frombuffer(b"a1" * size, np.uint8)[:size]
        for draw in (0, size - 1, size):
            n, cuts = fim.cut_places(data, np.array([0, size]), np.array([[draw], [size]]))
            assert n.tolist() == [size] and cuts.tolist() == [[draw % (size + 1)], [size]]


def features(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return len(words), [zlib.crc32(b" ".join(words[i : i + n])) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_importance(rows, target, buckets=10_000, percent=5, least=20):
    s, t = Counter(), Counter()
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            counts.update(f % buckets for f in features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n, found = features(text)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        w = sum(gain[f % buckets] for f in found)
        out.append([doc_id, n, len(found), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    chosen = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(chosen[: percent * len(chosen) // 100]):
        r[5] = k + 1
    return out


def test_importance_of_each_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 100), (-3, "word " * 100), (None, "One two THREE " * 30), (-5, "x" * 200 + " " + "é" * 70), (-6, "A-b 12 " * 200_000)], "doc_id long, text string")
    rows = docs.unionByName(extra)
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = importance.importance_resample(rows.withColumn("score", fim.F.lit("clash")), target)
    expected = plain_importance(rows.collect(), [r.text for r in target.collect()])
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, expected)))
    few = importance.importance_resample(rows, target.limit(0), percent=50, buckets=100)
    assert sorted(map(str, map(tuple, few.collect()))) == sorted(map(str, map(tuple, plain_importance(rows.collect(), [], 100, 50))))
    assert importance.importance_resample(rows.limit(0), target).count() == 0


def test_long_texts_are_cut_without_loss(monkeypatch):
    texts = [(t or "").encode() for t in fuzz(150, 6, "abcd,. 1é")] + [b"word, " * 500, b"a" * 999 + b" b c", b"one two " * 40 + b"." * 300 + b"three"]
    whole = [c for c in importance.bucket_counts(texts, 512)]
    monkeypatch.setattr(importance, "BLOCK", 30)
    cut = [c for c in importance.bucket_counts(texts, 512)]
    for (a, n), (b, m) in zip(whole, cut, strict=True):
        assert np.array_equal(a, b) and np.array_equal(n, m)


def test_planes_sum_exactly():
    rng = np.random.default_rng(7)
    counts, gains = (rng.pareto(0.5, (20, 333)) * 2).astype(np.int64), rng.integers(-20_000, 20_000, 333)
    counts[3] = 0
    assert np.array_equal(importance.GainPlanes(gains).weigh(counts), counts @ gains)


def test_sql_of_middles(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    got = queries.op12_fill_in_middle(spark, sf)
    found = duck.execute(queries.ORACLE_SQL["op12_fill_in_middle"])
    assert [d[0] for d in found.description] == got.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))
