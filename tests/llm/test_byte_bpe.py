"""Folded byte-level BPE against the library, and character classes of all code points."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import pre_tokenizers

from marlspar.llm import bpe, byte_bpe

FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = " \n\t'streveldm'ABé漢字1²٣ 　\u0085\x1c😀_-#.aaaa  \rꟋ\U00010d45"


@pytest.fixture(scope="module")
def library():
    with open(FILE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    r = random.Random(1)
    out = [None, "", "a", "it's' 's  x<|endoftext|> b", "x" * 3000, "-" * 5000 + "a", " " * 4000, "ab" * 2000, "\n\n\n  x", "é" * 1500, "aꟋ1 ꟋꟋ'll", "漢字仮名交じり文" * 300]
    out += ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 80))) for _ in range(800)]
    return out + ["".join(r.choice("aehinrt") for _ in range(n)) for n in (390, 400, 401, 700, 1500)]


def rows_of(texts, library):
    out = []
    for k, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        out.append((k if k % 50 else None, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_query_rows_equal_the_library(spark, library):
    rows = texts()
    df = spark.createDataFrame([(k if k % 50 else None, t) for k, t in enumerate(rows)], "doc_id long, text string").selectExpr("*", "1 as words", "2 as ids", "3 as n_tokens")
    got = byte_bpe.encode(df.repartition(2), FILE).collect()
    assert sorted(map(tuple, got), key=str) == rows_of(rows, library)
    assert byte_bpe.encode(df.limit(0), FILE).count() == 0


def test_ids_and_groups(spark, library, monkeypatch):
    """Small groups and parts give the same ids; repeated rows come twice."""
    monkeypatch.setattr(byte_bpe, "GROUP_BYTES", 200)
    monkeypatch.setattr(byte_bpe, "SPLIT_BYTES", 64)
    with open(FILE, "rb") as f:
        ranks = byte_bpe.Ranks(f.read())
    assert len(ranks.pairs) > len(ranks.pieces) - 256 and ranks.lookahead > 1
    rows = [(1, "The quick brown fox, it's 12 o'clock. " * 30), (2, "a"), (2, "a"), (3, None), (4, "漢字 " * 50 + "x" * 300 + "  \n y")]
    got = byte_bpe.token_ids(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), ranks).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((i, library.encode_ordinary(t or "")) for i, t in rows)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(byte_bpe, "SPLIT_BYTES", 50)
    r, splitter = random.Random(2), bpe.Splitter()
    for _ in range(300):
        raw = np.frombuffer("".join(r.choice(ALPHABET) for _ in range(r.randint(60, 400))).encode(), np.uint8)
        cuts = [*byte_bpe._cuts(splitter, raw)]
        assert [a for a, _ in cuts] == [0, *[b for _, b in cuts[:-1]]] and cuts[-1][1] == len(raw)
        parts = [a + s for a, b in cuts for s in splitter.split(raw[a:b], np.array([0, b - a])).tolist()]
        assert parts == splitter.split(raw, np.array([0, len(raw)])).tolist()


def test_classes_of_all_code_points():
    """Letters, numbers, white space and others as the library's pre-tokeniser has them, whatever Python's table says."""
    library, own = pre_tokenizers.ByteLevel(add_prefix_space=False), bpe.character_classes()
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for kind, before in ((bpe.LETTER, "a"), (bpe.NUMBER, "1"), (bpe.OTHER, "!")):
        for lo in range(0, len(chars), 5000):
            # every character stands between a mark of the kind and a space
            part = chars[lo : lo + 5000]
            words = [w for w, _ in library.pre_tokenize_str(" ".join(before + c + "\n" for c in part))]
            joined = sum(len(w.lstrip("Ġ")) > 1 for w in words if w.lstrip("Ġ").startswith(before))
            assert joined == sum(own[ord(c)] == kind for c in part), (kind, lo)
