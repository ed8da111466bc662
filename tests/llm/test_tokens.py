"""Token stores and byte-level BPE against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from seqspark.llm import bpe, token_store

WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, "One two, THREE.", "  \n\t ", "naïve café — 日本語 😀", "it's 12,345 I'll", "a" * 3000, "x\x01y \x01", "<|endoftext|> end", "é é", "same", "same"]


def table(spark, texts=TEXTS):
    return spark.createDataFrame([(10 * i if i != 5 else None, t, "extra", i) for i, t in enumerate(texts)], "doc_id long, text string, start string, n_tokens int")


def test_store_round_trip(spark):
    from tokenizers import Tokenizer

    manifest = token_store.write_tokens(table(spark), WORDS, last=1)
    got = token_store.read_tokens(manifest).orderBy("start").collect()
    rows = sorted(((10 * i if i != 5 else None, t) for i, t in enumerate(TEXTS)), key=lambda r: (r[0] is not None, r[0] or 0))
    t, start, flat = Tokenizer.from_file(WORDS), 0, []
    for r, (doc_id, text) in zip(got, rows, strict=True):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
        flat += ids
    wanted = spark.createDataFrame([(i,) for i in range(0, start, 3)] + [(start + 5,)], "place long")
    assert {r.place: r.id for r in token_store.tokens_at(manifest, wanted).collect()} == {i: flat[i] for i in range(0, start, 3)}


def test_ids_do_not_depend_on_what_came_before():
    """Random strings of control characters, NUL, marks and mixed scripts, after and before others, in a warmed memo."""
    from tokenizers import Tokenizer

    rng, t = random.Random(11), Tokenizer.from_file(WORDS)
    alphabet = [*"aabbcHEllo019.,'<|>-", *" " * 6, "\t", "\n", *"\0" * 4, "\x01", "\x1f", "\x7f", "\u0301", "\u0308", "é", "É", "ß", "×", "İ", "ſ", "日", "д", "א", "😀", "\u200d", "\u00a0", "\u0085", "\ufeff", "'s", "'ll", "hello"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(6000)]
    texts += ["hello hello\0", "hello\0 hello", "hello\0\0", "x" * 22, "x" * 23, "x" * 24, "x" * 22 + "\0", "x" * 23 + "\0", "word " * 4000]
    encoder = token_store.WordEncoder(WORDS)
    assert encoder.by_piece and encoder.mark is not None
    expected = [[*e.ids, 7] for e in t.encode_batch(texts, add_special_tokens=False)]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        for lo in range(0, len(texts), 500):
            some = list(order)[lo : lo + 500]
            got = encoder.encode([texts[i].encode() for i in some], 7)
            assert encoder.by_piece
            for i, ids in zip(some, got, strict=True):
                assert ids.tolist() == expected[i], texts[i]


def test_starts_in_groups_of_files(spark, monkeypatch):
    monkeypatch.setattr(token_store, "GROUP", 3)
    df = spark.range(40).selectExpr("id doc_id", "repeat('word ', cast(id % 7 as int)) text")
    spark.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        manifest = token_store.write_tokens(df, WORDS, last=1)
        assert manifest.count() > 6
        start = 0
        for r in token_store.read_tokens(manifest).orderBy("doc_id").collect():
            assert (r.start, r.n_tokens) == (start, r.doc_id % 7 + 1)
            start += r.n_tokens
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_empty_store(spark):
    manifest = token_store.write_tokens(table(spark).limit(0), WORDS)
    assert token_store.read_tokens(manifest).count() == 0


@pytest.mark.parametrize("high", [200, 60_000, 2**31])
def test_codes_have_random_access(high):
    rng = np.random.default_rng(high)
    ids = (rng.random(5000) ** 4 * high).astype(np.uint32)
    f = token_store.DacFile(np.frombuffer(b"".join(token_store.dac_bytes([7, None], np.array([3000, 5000]), ids)), np.uint8))
    at = rng.integers(0, 5000, 700)
    assert np.array_equal(f.take(at), ids[at]) and np.array_equal(f.doc(1), ids[3000:]) and f.doc_ids == [7, None]
    assert [x.tolist() for x in f.docs(100)] == [ids[:3000].tolist(), ids[3000:].tolist()]
    assert np.array_equal(f.range(511, 1025), ids[511:1025])


def test_bpe_is_tiktoken(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = [*TEXTS, "".join(rng.choice("abcdeéñ ") for _ in range(4000)), "".join(rng.choice("etaoin") for _ in range(2000)), "ab" * 900]
    df = table(spark, texts)
    ids = [r.ids for r in bpe.bpe_encode(df, RANKS, public_tokenizers.PATTERN).collect()]
    assert sorted(ids) == sorted(theirs.encode_ordinary(t or "") for t in texts)
    decoded = bpe.bpe_decode(bpe.bpe_encode(df, RANKS, public_tokenizers.PATTERN), RANKS).collect()
    assert sorted(bytes(r.decoded) for r in decoded) == sorted((t or "").encode() for t in texts)
    got = bpe.bpe_round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
    expected = sorted((len(i := theirs.encode_ordinary(t or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for t in texts)
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == expected
    assert bpe.bpe_round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
