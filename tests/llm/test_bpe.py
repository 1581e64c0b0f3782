import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from marlspar.llm import bpe, lengths
from marlspar.llm.queries import tokenizer_file

REF = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
ALPHABET = " \n\t'streveldm'ABé漢字1²٣ 　\u0085\x1c😀_-#.aaaa  \r"


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_file(), "rb") as f:
        return bpe.encoder_of(f.read())


def texts():
    r = random.Random(1)
    out = ["", "a", "'s", "it's' 's  x", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "x" * 3000, "-" * 5000 + "a", " " * 4000, "ab" * 4000, "\n\n\n  x", "é" * 3000]
    out += ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 60))) for _ in range(800)]
    return out + ["".join(r.choice("aehinrt") for _ in range(r.choice([700, 6000]))) for _ in range(10)]


def test_ids_equal_the_library(encoder):
    rows = [t.encode() for t in texts()]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows])))
    for text, ids in zip(texts(), encoder.rows(np.frombuffer(b"".join(rows), np.uint8), offsets), strict=True):
        assert [i for part in ids for i in part.tolist()] == REF.encode(text, add_special_tokens=False).ids, text[:60]


def test_stream_in_pieces_equals_whole(encoder):
    r = random.Random(2)
    for text in texts()[:200]:
        raw, pieces, at = text.encode(), [], 0
        while at < len(raw):
            n = r.randint(1, 40)
            pieces.append(raw[at : at + n])
            at += n
        got = [*encoder.stream(iter(pieces))]
        assert (np.concatenate(got).tolist() if got else []) == REF.encode(text, add_special_tokens=False).ids


def test_decoder_holds_back_broken_sequences(encoder):
    ids = np.array(REF.encode("漢字😀é", add_special_tokens=False).ids, np.uint32)
    d = bpe.Decoder(encoder)
    assert "".join([d.feed(ids[k : k + 1]) for k in range(len(ids))]) + d.feed(ids[:0], True) == "漢字😀é"
    d = bpe.Decoder(encoder)
    assert d.feed(ids[:1], True) == REF.decode(ids[:1].tolist(), skip_special_tokens=False)


def test_lookahead_is_finite_and_covers_the_longest_pair(encoder):
    assert 1 < encoder.table.lookahead < 10_000


def test_query_rows(spark):
    rows = [(1, "it's a test"), (2, None), (3, ""), (3, ""), (4, "x" * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_tokens")
    got = sorted(bpe.encode(df, tokenizer_file()).collect())
    assert [r.doc_id for r in got] == [1, 2, 3, 3, 4]
    for r, (_, t) in zip(got, rows, strict=True):
        ids = REF.encode(t or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(df.limit(0), tokenizer_file()).count() == 0


def test_length_sums(spark):
    words = ["a", "b c", None, "d e f g", "b c", ""]
    df = spark.createDataFrame([(t,) for t in words], "text string")
    n = [len(REF.encode(t or "", add_special_tokens=False).ids) for t in words]
    got = lengths.limits(lengths.histogram(df, tokenizer_file())).collect()
    assert sorted(r.limit_tokens for r in got) == sorted(set(n))
    for r in got:
        assert r.docs_within == sum(x <= r.limit_tokens for x in n) and r.docs_over == len(n) - r.docs_within
        assert r.truncated_tokens == sum(min(x, r.limit_tokens) for x in n) and r.all_tokens == sum(n)
        assert r.quantile == pytest.approx(r.docs_within / len(n))
    assert lengths.limits(lengths.histogram(df.limit(0), tokenizer_file())).count() == 0
    hist = lengths.histogram(df, tokenizer_file())
    asked = lengths.at(hist, [0, 2, 3, 3, 1000]).collect()  # some of them are no text's length
    assert {(r.limit_tokens, r.docs_within, r.truncated_tokens) for r in asked} == {(k, sum(x <= k for x in n), sum(min(x, k) for x in n)) for k in (0, 2, 3, 1000)}
    assert {(r.share, r.n_tokens) for r in lengths.quantiles(hist, [0.5, 1.0]).collect()} == {(0.5, sorted(n)[len(n) // 2 - 1]), (1.0, max(n))}


def test_limits_of_an_empty_histogram(spark):
    hist = lengths.histogram(spark.createDataFrame([], "text string"), tokenizer_file())
    assert [(r.limit_tokens, r.docs_within, r.truncated_tokens, r.quantile) for r in lengths.at(hist, [5]).collect()] == [(5, 0, 0, None)]
