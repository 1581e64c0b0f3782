"""Long texts stream in bounded memory."""

import hashlib
import tracemalloc

import numpy as np
import pytest
import tokenizers

from marlspar.llm import bpe
from marlspar.llm.queries import tokenizer_file

REF = tokenizers.Tokenizer.from_file(tokenizer_file())


@pytest.fixture(scope="module")
def encoder():
    with open(tokenizer_file(), "rb") as f:
        return bpe.encoder_of(f.read())


@pytest.mark.parametrize("piece", [7, 1000])
@pytest.mark.parametrize(
    "text",
    ["漢字仮名" * 700, "x" * 3000 + "'ll go" + " " * 2000 + "y", " " * 3000, "12" * 900 + "<|endoftext|>" + "\n" * 2500 + "z", "é" * 1500 + "'" + "s" * 1500, "-" * 2000 + " " + "漢" * 900 + "　" * 700 + "b"],
)
def test_words_longer_than_the_window(encoder, monkeypatch, text, piece):
    monkeypatch.setattr(bpe, "HOLD", 300)
    monkeypatch.setattr(bpe, "WINDOW", 256)
    raw = text.encode()
    got = np.concatenate([*encoder.stream(raw[k : k + piece] for k in range(0, len(raw), piece))])
    assert got.tolist() == REF.encode(text, add_special_tokens=False).ids


def test_memory_does_not_grow_with_the_text(encoder):
    """A text of one word without white space: ids come out while it is read, what is held stays small."""
    piece = ("漢字仮名交じり文" * 4_000).encode()
    peaks = []
    for n in (4, 16):
        tracemalloc.start()
        digest, most = hashlib.sha256(), 0
        state = bpe.Transducer(encoder)
        for _ in range(n):
            for ids in state.feed(piece):
                digest.update(ids.tobytes())
            most = max(most, len(state._held))
        assert most <= bpe.HOLD + encoder.table.lookahead + 4096
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.3 * peaks[0]
